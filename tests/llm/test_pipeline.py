"""The stages of the pipeline in a row, each on what the one before kept, beside brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from antecede.llm import mixing, toxicity
from antecede.llm.queries import byte_bpe
from antecede.session import materialize

PLAIN = "the quiet river ran past the old mill and people of the village walked there on summer evenings number"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `toxicity of the text` int, row int, hash string"
SECRET = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I)


def documents():
    rows = []
    for i in range(120):
        text = f"{PLAIN} {i} " + " ".join(f"w{i}x{j}" for j in range(i % 40))
        if i % 2 and i < 80:
            text += " you stupid idiot moron" + f" {i}"
        rows.append((i, text, "ab"[i % 2] if i % 5 else None))
    near = " ".join(f"n{j}" for j in range(60))
    rows += [(200, near + " one", "a"), (201, near + " two", "b"), (202, near + " one", "a"), (200, near + " one", "a")]
    rows += [(210, "login with password = hunter2hunter2 and go on " + near[::-1], "b"), (211, None, "a"), (212, "", None), (None, "an id that is null " + near[5:150], "a")]
    rows += [(220, "very long " * 3_000 + "end", "b")]
    return [(i, t, "en", s, len(t or ""), "dot", 7, 1, "x") for i, t, s in rows]


def shingles(text):
    words = re.findall(r"[0-9a-z]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, 1, int(i % 2 and i < 80)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(documents(), COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, folder))
        out.append((docs, after))
        docs = after
    return spark, folder, out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_come_along(stages):
    _, _, out = stages
    for before, after in out[:-1]:
        assert after.columns == before.columns == [f.split("`")[1] if "`" in f else f.split()[0] for f in COLUMNS.split(", ")]


def test_toxic_documents_go(stages):
    spark, folder, ((before, after), *_) = stages
    scored = toxicity.with_scores(before.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    rejected = {r.doc_id for r in scored if r.score >= 0.5}
    want = Counter({r: n for r, n in rows(before).items() if r[0] not in rejected})
    assert rows(after) == want
    kept = {r[0] for r in want}
    assert not any(i % 2 and i < 80 for i in kept if i is not None and i < 120) and kept >= {i for i in range(0, 120, 2)}


def test_one_of_each_group_stays(stages):
    _, _, (_, (before, after), *_) = stages
    had = [r for r, n in rows(before).items() for _ in range(n)]
    kept = rows(after)
    assert set(kept.values()) == {1} and set(kept) <= set(had)
    sets = {r: shingles(r[1]) for r in had}
    alike = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for r in set(had) - set(kept):  # what goes has a likeness that stays, with a smaller id
        assert any(alike(r, k) and k[0] <= r[0] for k in kept)
    some = list(kept)
    assert not any(alike(a, b) for i, a in enumerate(some) for b in some[:i])


def test_secrets_are_blotted_out(stages):
    _, _, (_, _, (before, after), *_) = stages
    was, now = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert set(was) == set(now)
    for i, r in now.items():
        if i == 210:
            assert "hunter2" not in r.text and "[secret]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == was[i] and not (r.text and SECRET.search(r.text))


def test_documents_are_taken_as_the_mix_says(stages):
    _, _, (*_, (before, after), _) = stages
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    plan = {(r.doc_id, r.source): r for r in mixing.mix(before).collect()}
    times = rows(after)
    sources = defaultdict(lambda: [0, 0, 0, 0])
    for r in rows(before):
        p = plan[r[0], r[3]]
        assert p.size == size(r[1]) and times[r] * p.size == p.taken and (times[r] <= 3 or not p.size)
        sources[r[3]][0] += p.size
        sources[r[3]][1] += p.taken
        sources[r[3]][2] = p.target
        sources[r[3]][3] = max(sources[r[3]][3], p.size)
    whole = sum(s[0] for s in sources.values())
    names = sorted(sources, key=lambda s: (s is None, s))
    for weight, name in zip((1, 2, 3), names, strict=True):
        own, taken, target, longest = sources[name]
        assert target <= 3 * own and (target == 3 * own or target >= whole * weight / 6 - 1e-6)
        assert taken <= target and target - taken <= longest  # less than a document


def test_every_id_has_one_place(stages):
    from tokenizers import Tokenizer

    _, _, (*_, (before, after)) = stages
    library = Tokenizer.from_file(byte_bpe())
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before.collect())
    pieces = after.collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in want.items())
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


def test_no_documents(spark, stages):
    _, folder, _ = stages
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder))
        assert docs.count() == 0


def test_run_is_the_stages_in_a_row(stages):
    spark, folder, out = stages
    columns = [F.count("*"), F.sum("length"), F.sum("ids_crc32")]
    assert corpus_pipeline.run(spark, folder).agg(*columns).first() == out[-1][1].agg(*columns).first()
