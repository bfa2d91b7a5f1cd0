"""Phrases of two to five words that occur together more often than their parts would.

Direct-address tiling.  Texts become chunks of word codes.  The frequent words of a language are ranked by frequency, and
every pair of neighbouring ranks falls into a tile of ``TILE`` x ``TILE`` ranks: tiles with many pairs are counted by a dense
bincount over their cells, all others as sorted coordinates.  The counts of a chunk are dealt to buckets by a hash of the
pair; a task sums up a bucket's counts over all chunks and tells each chunk which of its pairs stay frequent.  Those are
ranked by frequency themselves, and neighbouring pairs are counted the same way: a phrase of k words is the phrase of its
first k - 1 words followed by that of its last k - 1, so five words need four rounds.

A chunk holds about ``CHUNK`` words at most (more only of one piece) and meets only the counts of the words it holds, so no task needs
a whole vocabulary, and nothing of the corpus reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.session import discard, materialize, stored

CHUNK = 2_000_000  # words
BUCKET = 2_000_000  # pairs whose counts one task sums up, at most about as many
TILE = 512
DENSE = TILE * TILE // 8  # pairs from which a tile of a chunk is counted cell by cell
MOST_WORDS, LEAST_COUNT, KEPT, UNKNOWN = 5, 100, 2_000, "und"

#: Capitals to small letters, ends of pieces to one of them, tabs to spaces.
ENDS = b".,;:!?\n\x0b\x0c\r"
SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(ENDS))
END = b"."

CHUNKS = "lang string, codes binary, n_codes long, parts array<struct<bucket:int,base:long,body:binary>>"
FOUND = "chunk long, n long, own binary, lang string, id array<long>, f array<long>, word array<string>, a array<long>, b array<long>"


def tokens(text: str) -> list[bytes]:
    """Words in order, ``END`` where a piece ends."""
    return text.encode().translate(SMALL).replace(END, b" . ").split()


def _packed(array: np.ndarray) -> bytes:
    return pa.compress(array.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, dtype: str = "<i8") -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _chunk_row(lang: str, codes: np.ndarray, parts: list[dict], more: list[pa.Array] = (), names: list[str] = ()) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("base", pa.int64()), ("body", pa.binary())]))
    return pa.RecordBatch.from_arrays(
        [*more, pa.array([lang]), pa.array([_packed(codes.astype("<i4"))], pa.binary()), pa.array([len(codes)], pa.int64()), pa.array([parts], kind)],
        [*names, "lang", "codes", "n_codes", "parts"],
    )


def _dealt(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))[: len(starts)]
    return list(zip(bucket[starts].tolist(), starts.tolist(), ends.tolist(), strict=True))


class _Chunk:
    """Words of one language; a word's code is the place at which it first came."""

    def __init__(self):
        self.codes, self.parts, self.size = {END: -1}, [], 0

    def add(self, words: list[bytes]) -> None:
        codes = self.codes
        self.parts.append(np.fromiter((codes.setdefault(w, len(codes) - 1) for w in words), np.int32, len(words)))
        self.parts.append(np.full(1, -1, np.int32))
        self.size += len(words) + 1

    def row(self, lang: str, buckets: int) -> pa.RecordBatch:
        codes, words = np.concatenate(self.parts), list(self.codes)[1:]
        counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype("<i8")
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        name = np.empty(len(words) + 1, np.int32)
        name[order], name[-1] = np.arange(len(words)), -1  # the last: of -1
        counts = counts[order]
        parts = []
        for number, begin, end in _dealt(bucket[order]):
            own = counts[begin:end].tobytes() + b"\n".join([words[i] for i in order[begin:end].tolist()])  # no word holds a line end
            body = (end - begin).to_bytes(8, "little") + len(own).to_bytes(8, "little") + pa.compress(own, codec="zstd", asbytes=True)
            parts.append({"bucket": number, "base": begin, "body": body})
        return _chunk_row(lang, name[codes], parts)


def _cut(words: list[bytes], most: int):
    """Stretches of about ``most`` words that end with a piece."""
    at = 0
    while len(words) - at > most:
        try:
            end = words.index(END, at + most)
        except ValueError:
            break
        yield words[at:end]
        at = end + 1
    yield words[at:] if at else words


def _chunks(most: int, buckets: int):
    def run(batches):
        open_, held = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in _cut(tokens(text.as_py()), most):
                    own = open_.setdefault(lang, _Chunk())
                    own.add(words)
                    held += len(words) + 1
                    if own.size >= most:
                        held -= own.size
                        yield open_.pop(lang).row(lang, buckets)
                if held >= 2 * most:  # of many languages
                    yield from (own.row(name, buckets) for name, own in open_.items())
                    open_, held = {}, 0
        yield from (own.row(name, buckets) for name, own in open_.items())

    return run


def pair_index(codes: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of the different pairs of neighbouring codes, none negative, and the pair at each place or -1."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    a, b = codes[at].astype(np.int64), codes[at + 1].astype(np.int64)
    wide = -(-kinds // TILE) or 1
    tile = (a // TILE) * wide + b // TILE
    found, inverse, sizes = np.unique(tile, return_inverse=True, return_counts=True) if wide > TILE else _counted(tile, wide * wide)
    number = np.where(sizes >= DENSE, np.cumsum(sizes >= DENSE) - 1, -1)
    here = number[inverse]
    place = np.full(len(codes), -1, np.int64)
    out: list[list[np.ndarray]] = [[], [], []]
    many = here >= 0
    if many.any():  # dense: every cell of every such tile has its own counter
        cell = here[many] * (TILE * TILE) + (a[many] % TILE) * TILE + b[many] % TILE
        counts = np.bincount(cell)
        cells = np.flatnonzero(counts)
        name = np.zeros(len(counts), np.int64)
        name[cells] = np.arange(len(cells))
        place[at[many]] = name[cell]
        first = found[sizes >= DENSE][cells // (TILE * TILE)]
        out[0].append(first // wide * TILE + cells // TILE % TILE)
        out[1].append(first % wide * TILE + cells % TILE)
        out[2].append(counts[cells])
    few = ~many
    if few.any():  # sparse: sorted coordinates
        coords, own, counts = np.unique(a[few] * kinds + b[few], return_inverse=True, return_counts=True)
        place[at[few]] = own + sum(map(len, out[0]))
        out[0].append(coords // kinds)
        out[1].append(coords % kinds)
        out[2].append(counts)
    first, second, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return first, second, counts, place


def _counted(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.bincount(values, minlength=n)
    found = np.flatnonzero(counts)
    name = np.zeros(n, np.int64)
    name[found] = np.arange(len(found))
    return found, name[values], counts[found]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pairs(buckets: int, last: bool):
    """From the codes of a chunk and its frequent kinds (own code, id, count), in stretches: the pairs of the chunk, dealt to buckets."""

    def run(batches):
        for batch in batches:
            for chunk, lang, codes, n, found in zip(*batch.columns, strict=True):
                codes = _unpacked(codes.as_py(), n.as_py(), "<i4")
                known = [_unpacked(k["own"], 3 * k["n"]).reshape(3, -1) for k in found.as_py()]
                own = np.concatenate([np.cumsum(k[0]) for k in known])
                ids, often = (np.concatenate([k[i] for k in known]) for i in (1, 2))
                order = np.lexsort((ids, -often))  # small numbers for the frequent ones
                new = np.full(max(int(codes.max(initial=0)), int(own.max(initial=0))) + 2, -1, np.int64)  # the last: of -1
                new[own[order]] = np.arange(len(order))
                ids = ids[order]
                first, second, counts, place = pair_index(new[codes], len(ids))
                a, b = ids[first], ids[second]
                bucket = (_mixed(a, b) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((b, a, bucket))
                a, b, counts = a[order], b[order], counts[order]
                parts = []
                for number, begin, end in _dealt(bucket[order]):
                    values = np.concatenate([np.diff(a[begin:end], prepend=0), b[begin:end], counts[begin:end]]).astype("<i8")
                    parts.append({"bucket": number, "base": begin, "body": (end - begin).to_bytes(8, "little") + _packed(values)})
                name = np.empty(len(order) + 1, np.int64)
                name[order], name[-1] = np.arange(len(order)), -1
                keep = np.concatenate([[True], (place[1:] >= 0) | (place[:-1] >= 0)])  # one -1 between stretches
                codes = np.zeros(0, np.int32) if last else name[place[keep]]
                yield _chunk_row(lang.as_py(), codes, parts, [pa.array([chunk.as_py()], pa.int64())], ["chunk"])

    return run


def _found(rows: list[tuple], lang: str, ids, f, words=None, a=None, b=None) -> pa.RecordBatch:
    """What a bucket gives: for each chunk its frequent kinds, and in a row without chunk the kinds themselves."""
    long, n = pa.list_(pa.int64()), len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows] + [None], pa.int64())]
        + [pa.array([len(r[1]) for r in rows] + [None], pa.int64())]
        + [pa.array([_packed(np.concatenate([np.diff(r[1], prepend=0), *r[2:]]).astype("<i8")) for r in rows] + [None], pa.binary())]
        + [pa.array([None] * n + [lang], pa.string())]
        + [pa.array([None] * n + [x], long) for x in (ids, f)]
        + [pa.array([None] * n + [words], pa.list_(pa.string()))] + [pa.array([None] * n + [x], long) for x in (a, b)],
        ["chunk", "n", "own", "lang", "id", "f", "word", "a", "b"],
    )


def _frequent_words(bodies: list[tuple], least: int):
    """Counts of a bucket's words over all chunks (chunk, base, body); ids by frequency."""
    parts, total = [], Counter()
    for chunk, base, body in bodies:
        n, size = int.from_bytes(body[:8], "little"), int.from_bytes(body[8:16], "little")
        own = pa.decompress(body[16:], decompressed_size=size, codec="zstd", asbytes=True)
        words = own[8 * n :].split(b"\n")
        for word, count in zip(words, np.frombuffer(own, "<i8", n).tolist(), strict=True):
            total[word] += count
        parts.append((chunk, base, words))
    kept = sorted((-f, w) for w, f in total.items() if f >= least)
    ids = {w: i for i, (_, w) in enumerate(kept)}
    often = np.array([-f for f, _ in kept], np.int64)
    rows = []
    for chunk, base, words in parts:
        here = [(base + i, ids[w]) for i, w in enumerate(words) if w in ids]
        if here:
            own, own_ids = np.array(here, np.int64).T
            rows.append((chunk, own, own_ids, often[own_ids]))
    return rows, often, {"words": [w.decode() for _, w in kept]}


def _frequent_pairs(bodies: list[tuple], least: int):
    parts = []
    for _, _, body in bodies:
        n = int.from_bytes(body[:8], "little")
        a, b, counts = _unpacked(body[8:], 3 * n).reshape(3, n)
        parts.append((np.cumsum(a), b, counts))
    sizes = [len(p[0]) for p in parts]
    a, b, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    f = np.add.reduceat(counts[order], starts)
    kept = np.flatnonzero(f >= least)
    kept = kept[np.lexsort((b[starts[kept]], a[starts[kept]], -f[kept]))]
    ids = np.full(len(starts), -1, np.int64)
    ids[kept] = np.arange(len(kept))
    of = np.empty(len(order), np.int64)
    of[order] = ids[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))]
    often, rows, at = f[kept], [], 0
    for (chunk, base, _), size in zip(bodies, sizes, strict=True):
        own_ids = of[at : at + size]
        at += size
        here = np.flatnonzero(own_ids >= 0)
        if len(here):
            rows.append((chunk, base + here, own_ids[here], often[own_ids[here]]))
    return rows, often, {"a": a[starts[kept]], "b": b[starts[kept]]}


def _summed(count, least: int):
    """Rows (lang, bucket, chunk, base, body), those of a bucket in a row."""

    def run(batches):
        key, bodies = None, []

        def found():
            rows, often, names = count(bodies, least)
            high = key[1] << 32  # ids of other buckets differ
            rows = [(chunk, own, ids + high, f) for chunk, own, ids, f in rows]
            return _found(rows, key[0], np.arange(len(often)) + high, often, **names)

        for batch in batches:
            for lang, bucket, chunk, base, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, bucket) != key:
                    if bodies:
                        yield found()
                    key, bodies = (lang, bucket), []
                bodies.append((chunk, base, body))
        if bodies:
            yield found()

    return run


def _frequent(chunks: DataFrame, count, least: int) -> tuple[DataFrame, DataFrame]:
    """The frequent kinds with their count f and an id, and each chunk's codes with its own frequent kinds."""
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bodies = chunks.select("lang", "chunk", F.explode("parts").alias("p")).select("lang", "p.bucket", "chunk", "p.base", "p.body")
    dealt = bodies.repartition(tasks, "lang", "bucket").sortWithinPartitions("lang", "bucket", "chunk")
    found = materialize(dealt.mapInArrow(_summed(count, least), FOUND))
    names = ["word"] if count is _frequent_words else ["a", "b"]
    kinds = found.where("chunk IS NULL").select("lang", F.explode(F.arrays_zip("id", "f", *names)).alias("k")).select("lang", "k.*")
    own = found.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("n", "own")).alias("found"))
    return kinds, chunks.select("chunk", "lang", "codes", "n_codes").join(own, "chunk")  # a chunk's kinds are bounded


def _score(f: str, n: str, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 f n / (l r)), exactly."""
    whole = lambda c: c.cast("decimal(18,0)")
    above = (whole(F.col(f)) * whole(F.col(n))).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (whole(l) * whole(r)).cast("decimal(38,0)"))


def _totals(chunks: DataFrame) -> DataFrame:
    """Words of each language."""
    def run(batches):
        for batch in batches:
            for lang, codes, n in zip(*batch.columns, strict=True):
                words = int(np.count_nonzero(_unpacked(codes.as_py(), n.as_py(), "<i4") >= 0))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([words], pa.int64())], ["lang", "n"])

    each = chunks.select("lang", "codes", "n_codes").mapInArrow(run, "lang string, n long")
    return each.groupBy("lang").agg(F.sum("n").alias("n"))


def phrases(docs: DataFrame, longest: int = MOST_WORDS, least: int = LEAST_COUNT, kept: int = KEPT, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``kept`` phrases of each language.

    ``docs``: text and lang; other columns are ignored.  A null text is empty, a null lang is ``und``.  Repeated rows
    count each.  Ties go by count, then by the bytes of the phrase.  Texts of any length are read whole.  An empty
    table, or one without a phrase that occurs ``least`` times, gives no row.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = size // (6 * bucket) + 1
    cut = texts.mapInArrow(_chunks(chunk, buckets), CHUNKS)
    chunks, path = stored(cut.withColumn("chunk", F.monotonically_increasing_id()))
    kinds, sequences = _frequent(chunks, _frequent_words, least)
    known = materialize(kinds.select("lang", "id", F.col("word").alias("phrase"), "word", "f", *[F.array().cast("array<long>").alias(c) for c in ("heads", "tails")]))
    totals, longer = materialize(_totals(chunks)), []
    for k in range(2, longest + 1):
        chunks, new_path = stored(sequences.mapInArrow(_pairs(buckets, k == longest), f"chunk long, {CHUNKS}"))
        discard(docs.sparkSession, path)  # the codes before are needed no more
        path = new_path
        kinds, sequences = _frequent(chunks, _frequent_pairs, least)
        head = known.select("lang", F.col("id").alias("a"), F.col("phrase").alias("begin"), F.col("f").alias("fa"), F.col("heads").alias("ha"))
        tail = known.select("lang", F.col("id").alias("b"), F.col("word").alias("last"), F.col("f").alias("fb"), F.col("tails").alias("tb"))
        # heads[i]: count of the first i + 1 words; tails[i]: of what follows them.
        known = materialize(kinds.join(head, ["lang", "a"]).join(tail, ["lang", "b"]).select(
            "lang", "id", "a", "b", F.concat_ws(" ", "begin", "last").alias("phrase"), F.col("last").alias("word"), "f",
            F.concat("ha", F.array("fa")).alias("heads"), F.concat(F.array("fb"), "tb").alias("tails"),
        ))
        longer.append(known)
    candidates = []
    for k, own in enumerate(longer):
        if k + 1 < len(longer):  # one word more on either side is enough: counts only fall as phrases grow
            above = longer[k + 1]
            inside = above.select("lang", F.col("a").alias("id"), F.col("f").alias("held")).union(above.select("lang", "b", "f"))
            own = own.join(inside.groupBy("lang", "id").agg(F.max("held").alias("held")), ["lang", "id"], "left").where("held IS NULL OR held < f")
        candidates.append(own.select("lang", "phrase", "f", "heads", "tails"))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.union(more)
    cuts = F.transform(F.arrays_zip("heads", "tails"), lambda c, i: F.struct(
        _score("f", "n", c["heads"], c["tails"]).alias("score"), i.alias("cut"), c["heads"].alias("l"), c["tails"].alias("r")
    ))
    scored = every.join(totals, "lang").withColumn("low", F.array_min(cuts))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("f"), F.asc("phrase")))
    return scored.select(
        "lang", place.alias("rank"), "phrase", F.col("f").alias("a"), F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n",
        F.col("low.score").alias("score"),
    ).where(F.col("rank") <= kept).withColumn("rank", F.col("rank").cast("long"))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def phrases_sql(longest: int = MOST_WORDS, least: int = LEAST_COUNT, kept: int = KEPT) -> str:
    """The same in DuckDB's SQL: every phrase as a string."""
    return f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM pieces, range(1, {longest + 1}) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
inner_ones AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS held
  FROM candidates, range(2, {longest}) t(m), range(1, {longest}) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.f, cut, h.f AS l, t.f AS r, n, (1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f) AS score
  FROM candidates c JOIN range(1, {longest}) u(cut) ON cut < c.k JOIN totals USING (lang)
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
placed AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score::BIGINT AS score
  FROM lowest LEFT JOIN inner_ones USING (lang, phrase) WHERE held IS NULL OR held < f)
SELECT * FROM placed WHERE rank <= {kept}"""
