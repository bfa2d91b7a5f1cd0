"""Prefix tries, phrases and id files beside brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import id_coder, id_output, phrases, prefix_trie
from antecede.llm.chunks import ChunkEncoder
from antecede.llm.queries import byte_bpe, word_bpe

# ---- conversations ---------------------------------------------------------------------


def plain_trie(rows):
    """(conv_id, depth): (parent, members, children, leaves, saved, digest)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(w)] for c, w in own.items()}
    built = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + w[h:])
    members = defaultdict(list)
    for c, w in built.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].decode()) for q in below if q)
        digest = hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, digest)
    return out


TALK = (
    [(c, t, "user", f"turn {t} of {c % 3}") for c in range(0, 40) for t in range(c % 7)]
    + [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(9)]  # copies
    + [(c, t, "user", "x") for c in (1000, 1001) for t in range(400)]  # long, and in many ranges
    + [(205, None, None, None), (205, 0, "a", "é😀"), (205, 0, "a", "é😀"), (205, 0, "b", ""), (205, 0, "a", "tie")]
    + [(None, 0, "user", "of no conversation"), (7, 3, "user", "turn 3 of 1"), (312, 0, "u" * 300, "long" * 30_000)]
)
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize("members,queued", [(1_000, 500_000), (3, 2)])
def test_trie_equals_brute_force(spark, members, queued):
    rows = spark.createDataFrame([(*r, "clash") for r in TALK], CONVERSATIONS).repartition(5)
    got = prefix_trie.prefix_trie(rows, members, queued).collect()
    want = plain_trie(TALK)
    assert len(got) == len(want)
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == want


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_queue_spills_and_keeps_order():
    queue, rng = prefix_trie.SpillingQueue(8), np.random.default_rng(1)
    items = [tuple(map(int, rng.integers(-50, 50, 5))) for _ in range(500)]
    out = []
    for i, item in enumerate(items):
        queue.push(item)
        if i % 7 == 6:
            out.append(queue.pop())
    assert queue.files
    while queue.first() is not None:
        top = queue.first()
        out.append(queue.pop())
        assert out[-1] == top
    queue.close()
    assert sorted(out) == sorted(items) and out[len(items) // 7 :] == sorted(out[len(items) // 7 :])


# ---- phrases ---------------------------------------------------------------------------


def plain_phrases(rows, longest, least, kept):
    total, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und"
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", small):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in often.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:kept])]
    return out


def texts(seed):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "c", "É", "dd", "e e", "日本", "x" * 300]
    rows = []
    for i in range(120):
        picks = rng.choice(len(words), 40, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02])
        ends = rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"], 40)
        rows.append(("".join(words[w] + e for w, e in zip(picks, ends, strict=True)), ["en", "fr", None, "und"][i % 4]))
    return rows + [(None, "en"), ("", "xx"), ("...;", None), ("solo " * 3_000, "en"), ("solo " * 3_000, "en"), ("No.punctuation", "de")]


@pytest.mark.parametrize("chunk", [2_000_000, 50, 700])
def test_phrases_equal_brute_force(spark, chunk):
    rows = texts(chunk % 7)
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, n int").repartition(3)
    got = phrases.phrases(docs, 5, 20, 30, chunk, 50_000 if chunk > 50 else 40).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, 5, 20, 30))


def test_phrases_of_nothing(spark):
    assert phrases.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0


@pytest.mark.parametrize("tile,dense", [(512, 32_768), (4, 3), (4, 1), (2, 10**9)])
def test_tiles_count_every_pair(monkeypatch, tile, dense):
    monkeypatch.setattr(phrases, "TILE", tile)
    monkeypatch.setattr(phrases, "DENSE", dense)
    rng = np.random.default_rng(tile)
    for kinds in (1, 3, 9, 40):
        codes = np.minimum(rng.geometric(0.2, 500) - 1, kinds - 1).astype(np.int32)
        codes[rng.random(500) < 0.1] = -1
        first, second, counts, place = phrases.pair_index(codes, kinds)
        pairs = [(a, b) for a, b in zip(codes, codes[1:], strict=False) if a >= 0 and b >= 0]
        assert Counter(pairs) == {(a, b): n for a, b, n in zip(first, second, counts, strict=True)}
        assert [(first[p], second[p]) for p in place if p >= 0] == pairs
    assert [len(x) for x in phrases.pair_index(np.array([-1, 5, -1], np.int32), 6)] == [0, 0, 0, 3]


def test_long_texts_are_cut_between_pieces():
    words = phrases.tokens("a b c. d e f g h i j k. l m")
    parts = list(phrases._cut(words, 5))
    assert len(parts) > 1 and [w for p in parts for w in p if w != b"."] == [w for w in words if w != b"."]
    assert b".".join(b" ".join(p) for p in parts).replace(b" . ", b".") == b" ".join(words).replace(b" . ", b".")


# ---- id files --------------------------------------------------------------------------


@pytest.mark.parametrize("kinds,most", [(1, 1), (2, 40), (600, 50_000), (300, 2**32 - 1), (5_000, 49_407)])
@pytest.mark.parametrize("size,block", [(0, 16), (1, 16), (15, 16), (16, 16), (5_000, 64), (20_000, 4_096)])
def test_coder_round_trip(kinds, most, size, block):
    rng = np.random.default_rng(size + kinds)
    names = rng.integers(0, most, kinds, endpoint=True)
    ids = names[np.minimum(rng.geometric(0.05, size) - 1, kinds - 1)] if size else np.zeros(0)
    ids[size // 2 :] = ids[: size - size // 2] if size else 0  # something to predict
    cuts = [0, size // 3, size // 3, size]
    data = id_coder.pack_shard([5, None, -7], list(np.diff(cuts)), ids, block)
    docs, lengths, back = id_coder.open_shard(data)
    assert docs == [5, None, -7] and list(lengths) == list(np.diff(cuts)) and (back == ids).all()


def test_coder_learns_and_finds_damage():
    ids = np.tile(np.random.default_rng(3).integers(0, 49_000, 50), 400)
    data = id_coder.pack_shard([1], [len(ids)], ids)
    assert len(data) < len(ids)  # two bytes each without a model
    for at in (0, 9, 40, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 0x40
        with pytest.raises(id_coder.DamagedShard):
            id_coder.open_shard(bytes(bad))
    with pytest.raises(id_coder.DamagedShard):
        id_coder.open_shard(data[:20])


def test_blocks_carry_over_byte_borders():
    rng = np.random.default_rng(11)
    for seed in range(5):
        ids = (rng.random(30_000) < 0.001 * 10**seed / 1e4).astype(np.uint32)  # very sure predictions
        assert (id_coder.open_shard(id_coder.pack_shard([1], [len(ids)], ids, 128))[2] == ids).all()


def test_shards_coded_at_once_have_the_bytes_they_have_alone(monkeypatch):
    monkeypatch.setattr(id_coder, "LANES", 40)
    rng = np.random.default_rng(2)
    shards = []
    for i, (size, kinds) in enumerate([(0, 1), (5, 3), (1_000, 900), (700, 2), (64, 64), (2_100, 40), (64, 1), (63, 70)]):
        ids = rng.integers(0, 2**32 - 1, kinds, endpoint=True)[np.minimum(rng.geometric(0.05, size) - 1, kinds - 1)]
        shards.append(([i, None], [size // 2, size - size // 2], ids))
    blocks = []
    write, read = id_coder._write_blocks, id_coder._read_blocks
    monkeypatch.setattr(id_coder, "_write_blocks", lambda ranks, *x: blocks.append(ranks.shape[1]) or write(ranks, *x))
    monkeypatch.setattr(id_coder, "_read_blocks", lambda bodies, *x: blocks.append(len(bodies)) or read(bodies, *x))
    together = id_coder.pack_shards(shards, 64)
    # Blocks of 5 ids, of 63, and of 64 (16, 11, 1, 33 and 1 of them), forty at once.
    assert sorted(blocks) == sorted([1, 1, 40, 22])
    blocks.clear()
    for (docs, lengths, ids), (got, sums, back) in zip(shards, id_coder.open_shards(together), strict=True):
        assert got == docs and list(sums) == lengths and (back == ids).all()
    assert sorted(blocks) == sorted([1, 1, 40, 22])
    assert together == [id_coder.pack_shard(*x, 64) for x in shards]
    bad = bytearray(together[3])
    bad[-1] ^= 1
    with pytest.raises(id_coder.DamagedShard):
        id_coder.open_shards([together[2], bytes(bad)])


STRANGE = [
    "Plain words, don't they've 12345 !!! mixed-Case", "", " ", "É été ÀÇ ﬁ ß İ Σας ΣΑΣ", "a\x1cb \x1f c", "nb sp em　wide\x85nel",
    "é combining ́alone", "日本語 テキスト 한국어 ก็", "😀👍🏽 x", "<|startoftext|> hi <|endoftext|>", "w" * 3_000, "½ ² ª º µ ①", "'S 'T 'LL I'm", "a\n\n\tb\r\n",
]


def test_chunks_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    marks = list("aAéÉ'sStTlLdD09.,!?-  \n\t ́日Σßİ<|>")
    latin = list("aAéÉß'''sStTrRvVeElLmMdD09.- \n")
    texts = STRANGE + ["".join(rng.choice(m, n)) for m in (marks, latin, latin) for n in range(250)] + ["\n".join(STRANGE)]
    for path in (word_bpe(), byte_bpe()):
        library, own = Tokenizer.from_file(path), ChunkEncoder(path)
        for text in texts:
            assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert own.many(texts) == [own.ids(t) for t in texts]


def test_words_are_merged_once_and_found_in_a_full_table():
    from antecede.llm import chunks

    own = ChunkEncoder(word_bpe())
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeéßÿ'019.-"), n)) for n in rng.integers(1, 24, 3_000)]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 7, 5_000, 20_000)] + ["", "Aa " * 9, "x" * 16 + " " + "x" * 17]
    want = [own.ids(t) for t in texts]
    merged, calls = own.merged, []
    own.merged = lambda word: calls.append(word) or merged(word)
    assert own.many(texts) == want and calls and len(calls) == len(set(calls))
    calls.clear()
    assert own.many(texts[::-1]) == want[::-1]
    assert not [w for w in calls if len(w) <= chunks.LONGEST_PACKED]
    for bits in (1, 4, 9):  # most words find no room
        own.table = chunks._Table(own.dtype, bits)
        for some in (["b"], ["c b"], texts[:3], texts, texts[:1] * 3, texts):
            assert own.many(some) == [own.ids(t) for t in some]
        assert own.table.words <= 1 << (bits - 1)


def test_first_letters_as_two_numbers():
    from antecede.llm.chunks import packed_words

    data = np.frombuffer(b"a bcdefghi jklmnopqrstuvwxyz0123 4\n" + b"\n" * 29, np.uint8)
    starts, ends = np.array([0, 2, 11, 33]), np.array([1, 10, 32, 34])
    low, high = packed_words(data, starts, ends - starts)
    got = [int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") for a, b in zip(low, high, strict=True)]
    assert got == [w.ljust(16, b"\0") for w in (b"a", b"bcdefghi", b"jklmnopqrstuvwxy", b"4")]


def test_files_of_ids_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe())
    rows = [(i, t) for i, t in enumerate(STRANGE, 100)] + [(None, "null id"), (3, None), (3, "again"), (3, "again"), (-5, "below zero"), (9, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(ids(r[1])))):
        own = ids(text)
        want.append((doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    shards = id_output.write_ids(docs, word_bpe(), f"file://{tmp_path}/ids")
    got = [tuple(r) for r in id_output.read_documents(shards).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    back = {(r.doc_id, tuple(r.ids)) for r in id_output.read_ids(shards).collect()}
    assert back == {(i, tuple(ids(t))) for i, t in rows}


def test_files_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string").withColumn("extra", F.lit(1))
    assert id_output.round_trip(empty, word_bpe()).count() == 0
