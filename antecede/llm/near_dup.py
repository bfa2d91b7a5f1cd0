"""Near duplicates by consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of all five-word shingles of all documents are counted in a sketch of fixed size: two rows of
   counters, added up in two levels, less the load that chance brings.
2. Every document gets ``BANDS * ROWS`` samples (improved consistent weighted sampling): two documents agree in a sample with
   the probability of their weighted Jaccard similarity.  Documents with the same words in the same order are one node.
3. Nodes that agree in a whole band meet the smallest node of that band's bucket.  Then, within each bucket, nodes whose
   components still differ meet.  A pair whose samples do not already speak against it is verified on the whole texts:
   its weighted or its plain similarity, without weights, must reach the threshold.
   Nodes of buckets of more than ``PAIRED`` nodes are not paired: they are dealt into families, and pieces of a family
   meet in blocks, where all similarities are one matrix product; a block gives a spanning forest of its links.
4. Connected components of the verified links are the groups.

Numpy works on whole batches of bytes; Spark does all grouping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.llm.graph import components, spread
from antecede.llm.vectors import blocks
from antecede.llm.rows import whole_row
from antecede.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 5  # 0.998 of pairs at the threshold share a band
CELLS = 1 << 20  # of each of the sketch's two rows
SLICE = 1 << 15
IDF_FLOOR = 0.8
PAIRED = 64
PIECE = 1_000
CHUNK = 1 << 20  # bytes of text at once
KEY = 54  # bits of a shingle's hash; above them the document's place in its chunk
SIGNED = "doc_id long, k1 long, k2 long, d1 long, d2 long, sig binary, bands array<long>"

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
MASK = U((1 << KEY) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, made longer when a text asks for it."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK + (1 << 16))
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up, self.down


POWERS, ORDER_1, ORDER_2 = _Powers(int(BASE)), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of lower-case UTF-8 ``data``, and where each document's words start (one bound more)."""
    is_word = WORD_BYTE[data]
    before = np.empty_like(is_word)
    before[1:] = is_word[:-1]
    before[:1] = False
    starts_doc = ends[:-1][ends[:-1] < len(data)]
    before[starts_doc] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[:-1] = is_word[1:]
    after[-1:] = False
    last = starts_doc[starts_doc > 0] - 1
    after[last] = False
    stop = np.flatnonzero(is_word & ~after) + 1
    up, down = POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mixed((total[stop] - total[start]) * down[start]), np.searchsorted(start, ends)


def shingles_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the distinct shingles; the key holds the document's place above ``KEY`` bits of hash, in order.

    A document of fewer than five words has one shingle, all its words; one without words has none.
    """
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    place = np.arange(len(words)) - bounds[:-1][doc]
    first = (place <= n[doc] - SHINGLE) | ((place == 0) & (n[doc] < SHINGLE))
    at = np.flatnonzero(first)
    room = np.concatenate([words, np.zeros(SHINGLE, dtype=U)])
    value = n[doc[at]].clip(max=SHINGLE).astype(U)
    for i in range(SHINGLE):
        inside = place[at] + i < n[doc[at]]
        value = value * U(0x9FB21C651E98DF25) + np.where(inside, room[at + i], U(0))
    keys = np.sort((doc[at].astype(U) << U(KEY)) | (mixed(value) & MASK))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def chunks(column: pa.Array):
    """(from, to, bytes, document ends) of runs of documents of about ``CHUNK`` bytes, fewer than 1,000 each."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1
        to = min(max(to, at + 1), at + 1000, len(column))
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def _count_batches(batches):
    rows, docs, waiting, held = np.zeros((2, CELLS), dtype=np.int64), 0, [], 0

    def add():
        if waiting:
            keys = np.concatenate(waiting)
            rows[0] += np.bincount((keys & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
            rows[1] += np.bincount(((keys >> U(20)) & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
            waiting.clear()

    for batch in batches:
        docs += batch.num_rows
        for _, _, data, ends in chunks(batch.column(0)):
            waiting.append(shingles_of(*words_of(data, ends))[0] & MASK)
            held += len(waiting[-1])
            if held > 2_000_000:
                add()
                held = 0
    add()
    if docs:
        flat = rows.reshape(-1, SLICE)
        used = np.flatnonzero(flat.any(axis=1))
        blobs = [flat[i].astype("<u4" if flat[i].max() < 1 << 32 else "<u8").tobytes() for i in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int32()), pa.array([np.array([docs], "<u8").tobytes(), *blobs], pa.binary())], ["slot", "counts"]
        )


def _sum_blobs(part: pd.DataFrame) -> pd.DataFrame:
    slot = int(part["slot"].iloc[0])
    n = 1 if slot < 0 else SLICE
    total = np.zeros(n, dtype=np.int64)
    for blob in part["counts"]:
        total += np.frombuffer(blob, dtype="<u4" if len(blob) == 4 * n else "<u8").astype(np.int64)
    return pd.DataFrame({"slot": [slot], "counts": [total.astype("<u8").tobytes()]})


class Weights:
    """Smoothed inverse document frequency: 1 for a shingle of one document, ``floor`` for one of all."""

    def __init__(self, counts: np.ndarray, docs: int, floor: float = IDF_FLOOR):
        load = counts.sum(axis=1, keepdims=True)
        chance = (load - counts) / (CELLS - 1)
        df = np.maximum(counts - chance, 1.0)
        self.docs, self.floor, self.df = docs, floor, df.astype(np.float32)

    def __call__(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        df = np.minimum(
            self.df[0][(keys & U(CELLS - 1)).astype(np.int64)], self.df[1][((keys >> U(20)) & U(CELLS - 1)).astype(np.int64)]
        )
        share = np.log(df) / np.float32(max(np.log(max(self.docs, 2)), 1e-6))
        return (counts * (1 - (1 - self.floor) * np.clip(share, 0, 1))).astype(np.float32)


def frequencies(texts: DataFrame) -> Weights:
    """Weights from all documents of ``texts`` (text, lower case).  The sketch has 2 * CELLS counters however many they are."""
    parts = texts.select("text").mapInArrow(_count_batches, "slot int, counts binary").withColumn(
        "salt", F.floor(F.spark_partition_id() / 64)
    )
    some = parts.groupBy("slot", "salt").applyInPandas(_sum_blobs, "slot int, counts binary")
    total = some.groupBy("slot").applyInPandas(_sum_blobs, "slot int, counts binary")
    counts, docs = np.zeros((2 * CELLS // SLICE, SLICE), dtype=np.int64), 0
    for slot, blob in total.collect():  # at most 2 * CELLS / SLICE + 1 rows
        if slot < 0:
            docs = int(np.frombuffer(blob, "<u8")[0])
        else:
            counts[slot] = np.frombuffer(blob, "<u8")
    return Weights(counts.reshape(2, CELLS), docs)


class Sampler:
    """Improved consistent weighted sampling.

    The variates of a shingle and a sample are cut from one 32-bit hash of both: r and c are gamma(2, 1) quantiles (1,024 and
    4,096 of them), beta has 1,024 steps.
    """

    def __init__(self, samples: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.seeds = random.integers(1, 1 << 32, samples, dtype=np.uint32)
        quantiles = lambda n: np.sort(random.standard_gamma(2.0, (256, n)), axis=1).mean(axis=0)
        r = quantiles(1024)
        self.r, self.by_r, self.log_c = r.astype(np.float32), (1 / r).astype(np.float32), np.log(quantiles(4096)).astype(np.float32)
        self.beta = (np.arange(1024, dtype=np.float32) + np.float32(0.5)) / np.float32(1024)

    def __call__(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The smallest ln(a) of each document (from ``starts``) for each sample: equal only for the same shingle and step."""
        out = np.empty((len(self.seeds), len(starts)), dtype=np.float32)
        x, log_w = (keys & U(0xFFFFFFFF)).astype(np.uint32), np.log(weights)
        # A few ten thousand shingles at once stay in the cache; pieces end where documents end, if they can.
        at = 0
        ends = np.append(starts[1:], len(keys))
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + 16_384)))
            part, first = slice(int(starts[at]), int(ends[to - 1])), starts[at:to] - starts[at]
            xs, ws = x[part], log_w[part]
            h, t = np.empty_like(xs), np.empty_like(xs)
            for k, seed in enumerate(self.seeds):
                np.bitwise_xor(xs, seed, out=h)
                h *= np.uint32(0x85EBCA6B)
                h ^= np.right_shift(h, 15, out=t)
                h *= np.uint32(0xC2B2AE35)
                h ^= np.right_shift(h, 16, out=t)
                which = np.right_shift(h, 22, out=t).astype(np.intp)
                r = self.r.take(which)
                step = self.by_r.take(which)
                step *= ws
                beta = self.beta.take(np.bitwise_and(h, 1023, out=t).astype(np.intp))
                step += beta
                np.floor(step, out=step)
                step -= beta
                step += 1
                step *= r
                h >>= 10
                h &= 4095
                a = self.log_c.take(h.astype(np.intp))
                a -= step
                np.minimum.reduceat(a, first, out=out[k, at:to])
            at = to
        return np.ascontiguousarray(out.T)


def _sequence(words: np.ndarray, bounds: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of each document's words in order."""
    n = np.diff(bounds)
    up, _ = powers.get(int(n.max(initial=0)) + 1)
    doc = np.repeat(np.arange(len(n)), n)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * up[np.arange(len(words)) - bounds[:-1][doc]], out=total[1:])
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U)).view(np.int64)


def _sign(weights, bands: int, rows: int):
    sampler = Sampler(bands * rows)

    def run(batches):
        weigh = weights.value
        for batch in batches:
            for at, to, data, ends in chunks(batch.column(3)):
                words, bounds = words_of(data, ends)
                keys, counts = shingles_of(words, bounds)
                d1, d2 = _sequence(words, bounds, ORDER_1), _sequence(words, bounds, ORDER_2)
                sig, key = [None] * (to - at), [[]] * (to - at)
                if len(keys):
                    doc = (keys >> U(KEY)).astype(np.int64)
                    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    samples = sampler(keys, weigh(keys, counts), starts).view(np.uint32)
                    value = np.zeros((len(starts), bands), dtype=U) + np.arange(bands, dtype=U)
                    for r in range(rows):
                        value = mixed(value * U(31) + samples[:, r::rows].astype(U) + U(1))
                    value = value.view(np.int64).tolist()
                    few = ((samples * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                    for i, d in enumerate(doc[starts].tolist()):
                        sig[d], key[d] = few[i].tobytes(), value[i]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, to - at) for i in range(3)), pa.array(d1), pa.array(d2),
                     pa.array(sig, pa.binary()), pa.array(key, pa.list_(pa.int64()))],
                    ["doc_id", "k1", "k2", "d1", "d2", "sig", "bands"],
                )

    return run


def _plausible(threshold: float):
    """Pairs whose samples agree often enough for the threshold, with four standard errors to spare."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            k = a.shape[1]
            agree = (a == b).mean(axis=1) if k else np.zeros(batch.num_rows)
            least = threshold - 4 * np.sqrt(threshold * (1 - threshold) / max(k, 1))
            yield batch.filter(pa.array(agree >= least)).select([0, 1])

    return run


def similarities(left: list[str], right: list[str], weigh) -> np.ndarray:
    """The greater of the weighted and the plain Jaccard similarity of each pair of texts (fewer than 500 pairs)."""
    texts = [t for pair in zip(left, right, strict=True) for t in pair]
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    keys, counts = shingles_of(*words_of(np.frombuffer(b"".join(raw), np.uint8), ends))
    doc = (keys >> U(KEY)).astype(np.int64)
    pair = doc >> 1
    joint = (pair.astype(U) << U(KEY)) | (keys & MASK)
    order = np.argsort(joint, kind="stable")
    joint, pair = joint[order], pair[order]
    same = np.flatnonzero(joint[1:] == joint[:-1])
    found = np.zeros(len(left))
    for w in (weigh(keys, counts).astype(np.float64)[order], counts.astype(np.float64)[order]):
        both = np.bincount(pair[same], np.minimum(w[same], w[same + 1]), minlength=len(left))
        total = np.bincount(pair, w, minlength=len(left))
        found = np.maximum(found, both / np.maximum(total - both, 1e-12))
    return found


def _verify(weights, threshold: float):
    def run(batches):
        weigh = weights.value
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(a):
                to, size = at, 0
                while to < len(a) and to < at + 400 and (to == at or size < CHUNK):
                    size += len(left[to]) + len(right[to])
                    to += 1
                good = np.flatnonzero(similarities(left[at:to], right[at:to], weigh) >= threshold - 1e-9) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"]
                )
                at = to

    return run


def _sets(weights):
    """Of each node: its shingles, how often each occurs, and their weights, as bytes."""

    def run(batches):
        weigh = weights.value
        for batch in batches:
            for at, to, data, ends in chunks(batch.column(3)):
                keys, counts = shingles_of(*words_of(data, ends))
                one = weigh(keys, np.ones(len(keys), dtype=np.int64))
                bounds = np.searchsorted(keys >> U(KEY), np.arange(to - at + 1, dtype=U))
                parts = [
                    pa.array([v[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                    for v in (keys & MASK, counts.astype(np.int64), one)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, to - at) for i in range(3)), *parts],
                    ["row", "owner", "family", "keys", "counts", "idf"],
                )

    return run


def _elements(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, document, weight): a shingle that occurs n times is n elements, so the smaller weight of two is a sum."""
    keys, counts, idf = (np.frombuffer(b"".join(part[c]), t) for c, t in (("keys", U), ("counts", np.int64), ("idf", np.float32)))
    doc = np.repeat(np.arange(len(part)), part["keys"].map(len).to_numpy() // 8)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(keys, counts) + nth.astype(U) * BASE), np.repeat(doc, counts), np.repeat(idf, counts).astype(np.float64)


def _meet(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[~part["asked"]], part[part["asked"]]]
        (e1, d1, w1), (e2, d2, w2) = (_elements(s) for s in sides)
        n1, n2 = (len(s) for s in sides)
        sums = lambda w1, w2: np.bincount(d1, w1, n1)[:, None] + np.bincount(d2, w2, n2)[None]
        total, plain_total = sums(w1, w2), sums(None, None)
        shared = np.intersect1d(e1, e2)
        both, plain = np.zeros((n1, n2)), np.zeros((n1, n2))
        places = []
        for e, d, w in ((e1, d1, w1), (e2, d2, w2)):
            at = np.searchsorted(shared, e)
            known = at < len(shared)
            known[known] = shared[at[known]] == e[known]
            order = np.argsort(at[known], kind="stable")
            places.append((at[known][order], d[known][order], np.sqrt(w[known][order])))
        for low in range(0, len(shared), 2048):
            width = min(2048, len(shared) - low)
            grids = []
            for (at, d, w), n in zip(places, (n1, n2), strict=True):
                a, b = np.searchsorted(at, [low, low + width])
                grid = np.zeros((n, width))
                grid[d[a:b], at[a:b] - low] = w[a:b]
                grids.append(grid)
            both += grids[0] @ grids[1].T
            plain += (grids[0] > 0).astype(np.float64) @ (grids[1] > 0).astype(np.float64).T
        hits = np.maximum(both / np.maximum(total - both, 1e-12), plain / np.maximum(plain_total - plain, 1e-12)) >= threshold - 1e-9
        rows, owners = [s["row"].to_numpy() for s in sides], np.concatenate([s["owner"].to_numpy() for s in sides])
        least = np.concatenate(spread(hits, *rows))
        rows = np.concatenate(rows)
        # Ties to a row of the same component tell nothing new.
        owner = dict(zip(rows.tolist(), owners.tolist(), strict=True))
        tied = np.array([owner[a] != owner[b] for a, b in zip(rows.tolist(), least.tolist(), strict=True)], dtype=bool)
        return pd.DataFrame({"a": rows[tied], "b": least[tied]}).drop_duplicates()

    return run


def _family_links(hot: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links between components among the nodes (key, node, owner) of large buckets."""
    low = hot.groupBy("key").agg(F.min("node").alias("a"))
    family = materialize(components(hot.join(materialize(low), "key").select("a", F.col("node").alias("b"))))
    of = hot.select("node", "owner").distinct().join(family, "node")
    found = texts.join(of, "node").select(F.col("node").alias("row"), "owner", F.col("component").alias("family"), "text")
    schema = "row long, owner long, family long, keys binary, counts binary, idf binary"
    sets = materialize(found.mapInArrow(_sets(weights), schema).dropDuplicates(["row"]))
    met = blocks(sets, sets, ["family"], PIECE, PIECE)
    return materialize(met.groupBy("family", "x", "y").applyInPandas(_meet(threshold), "a long, b long"))


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough; ``texts`` has the texts of nodes."""
    sig = nodes.select("node", "sig")
    signed = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(
        sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b"
    )
    likely = materialize(signed.select("a", "b", "sa", "sb").mapInArrow(_plausible(threshold), "a long, b long"))
    asked = likely.select(F.explode(F.array("a", "b")).alias("node"))
    found = materialize(texts.join(asked, "node", "left_semi"))
    with_a = likely.join(found.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
    with_b = with_a.join(found.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return materialize(with_b.select("a", "b", "ta", "tb").mapInArrow(_verify(weights, threshold), "a long, b long").distinct())


def row_keys() -> list[Column]:
    """128 bits of a row's doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(2), text, "doc_id").alias("k2")]


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, k1, k2 (``row_keys``), group_id, kept of every row of ``docs`` (doc_id, text; others ignored).

    ``group_id`` is the smallest doc_id of the row's group, ``kept`` marks one row of each group (that doc_id, the first
    if it repeats).  Words are runs of letters and digits in lower case.  Documents with the same words in the same order are
    copies; a document without words (also null) is alone and kept.  Null ids come last: a group of null ids has a null
    group_id.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )
    weights = spark.sparkContext.broadcast(frequencies(texts))  # 2 * CELLS counters, whatever the input
    signed = materialize(texts.mapInArrow(_sign(weights, bands, rows), SIGNED).withColumn("row", F.monotonically_increasing_id()))
    same = materialize(signed.where("sig IS NOT NULL").groupBy("d1", "d2").agg(F.min("row").alias("node")))
    member = signed.select("row", "doc_id", "k1", "k2", "d1", "d2", F.col("sig").isNotNull().alias("worded")).join(same, ["d1", "d2"], "left")
    member = materialize(member.select("row", "doc_id", "k1", "k2", F.when(F.col("worded"), F.col("node")).otherwise(F.col("row")).alias("node")))
    nodes = signed.join(same.select("node"), F.col("row") == F.col("node"), "left_semi").withColumnRenamed("row", "node")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    low = keys.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
    buckets = materialize(keys.join(materialize(low), "key"))
    first = buckets.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    # The texts of nodes that share a bucket, shuffled once.
    wanted = nodes.join(buckets.select("node"), "node", "left_semi").select("node", "k1", "k2")
    fetched = materialize(texts.join(wanted, ["k1", "k2"]).select("node", "text"))
    edges = _links(first, nodes, fetched, weights, threshold)
    owner = materialize(components(edges))
    placed = materialize(buckets.join(owner, "node", "left").select("key", "node", "low", F.coalesce("component", "node").alias("owner")))
    split = placed.groupBy("key").agg(F.min("owner").alias("x"), F.max("owner").alias("y")).where("x <> y").select("key")
    sizes = placed.groupBy("key").agg(F.count("*").alias("size"))
    left = materialize(placed.join(split, "key", "left_semi").join(sizes, "key"))
    hot = left.where(F.col("size") > PAIRED).select("key", "node", "owner")
    met = _family_links(hot, fetched, weights, threshold)
    # Both stand apart from the bucket's smallest node or in another component than it: pairs with it have been tried.
    rest = left.where((F.col("size") <= PAIRED) & (F.col("node") != F.col("low")))
    second = rest.alias("p").join(rest.alias("q"), "key").where("p.node < q.node AND p.owner <> q.owner").select(
        F.col("p.node").alias("a"), F.col("q.node").alias("b")
    ).distinct()
    more = _links(second, nodes, fetched, weights, threshold)
    owner = materialize(components(edges.union(more).union(met)))
    placed = member.join(owner, "node", "left").select(
        "row", "doc_id", "k1", "k2", F.coalesce("component", "node").alias("component")
    )
    placed = materialize(placed)
    # The keeper is the smallest id, nulls last, and of its rows the first.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    keeper = materialize(placed.groupBy("component").agg(least))
    return placed.join(keeper, "component").select(
        "row", "doc_id", "k1", "k2", F.col("least.doc_id").alias("group_id"), (F.col("row") == F.col("least.row")).alias("kept")
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row of each group, as ``groups`` marks it.

    Rows that repeat in id and text are copies too: one stays.
    """
    marked = materialize(groups(docs, threshold, bands, rows).where("kept").select("k1", "k2"))
    keyed = docs.select(whole_row(docs).alias("row of the input"), *row_keys())
    return keyed.join(marked, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row of the input.*")
