"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import vector_links, vector_search
from antecede.llm.graph import components, merge
from antecede.llm.vector_links import traverse

SCHEMA = "vec_id long, embedding array<float>"


def family(random, dim, n, spread):
    center = random.standard_normal(dim)
    return [center / np.linalg.norm(center) + spread * random.standard_normal(dim) / np.sqrt(dim) for _ in range(n)]


def vectors(seed=0, dim=16):
    random = np.random.default_rng(seed)
    found = [v for _ in range(40) for v in family(random, dim, int(random.integers(1, 6)), 0.25)]
    found += family(random, dim, 150, 0.12)  # a large group of near copies
    same = random.standard_normal(dim)
    found += [same] * 60 + [2 * same]  # copies, and one of another length
    found += list(random.standard_normal((400, dim)) * random.uniform(0.5, 2, (400, 1)))
    return [(i, np.float32(v).tolist()) for i, v in enumerate(found)]


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [float("inf")] * 16), (9005, [None] + [1.0] * 15),
       (9006, []), (9007, [1.0, 2.0, 3.0]), (9008, [1.0, 2.0, 3.1]), (9020, [5.0, 2.0, 3.1])]


def test_links_against_all_pairs(spark):
    rows = vectors()
    table = spark.createDataFrame(rows + ODD + [(None, [1.0] + [0.0] * 15), (7, rows[7][1])], SCHEMA).withColumn("n", F.lit("clash"))
    got = vector_links.links(table).collect()
    assert len(got) == len(rows) + len(ODD) + 2
    x = np.array([v for _, v in rows] + [rows[7][1]], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in rows] + [7]
    linked = x @ x.T >= 0.95
    want = {}
    owner = np.array(ids)
    for _ in range(len(ids)):
        new = np.where(linked, owner[None], 10**9).min(axis=1)
        if (new == owner).all():
            break
        owner = new
    for i, n, c in zip(ids, linked.sum(axis=1) - 1, owner, strict=True):
        want[i] = (int(n), int(c), i == c)
    for r in got:
        if r.vec_id is not None and r.vec_id < 9000:
            assert (r.n_links, r.component_id, r.kept) == want[r.vec_id], r
    odd = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id > 9000}
    for i in (9001, 9002, 9003, 9004, 9005, 9006, 9020):
        assert odd[i] == (0, i, True)
    assert odd[9007] == (1, 9007, True) and odd[9008] == (1, 9007, False) and odd[None] == (0, None, True)


def test_search_against_all_rows(spark):
    rows = vectors(1)
    table = spark.createDataFrame(rows + ODD + [(None, rows[3][1])], SCHEMA).withColumn("rank", F.lit("clash"))
    got = {}
    for r in vector_search.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([v for _, v in rows] + [rows[3][1]], dtype=np.float64)
    ids = np.array([i for i, _ in rows] + [10**12])
    assert set(got) == {i for i, _ in rows if i % 20 == 0} | {9020}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        if q == 9020:
            assert [i for _, i, _ in found] == [9008, 9007]
            continue
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        hits += len({None if ids[i] == 10**12 else int(ids[i]) for i in order} & {i for _, i, _ in found})
        total += 20
        assert all(b == pytest.approx(float(x[q] @ x[i]), abs=1e-12) for _, i, b in found if i is not None)
    assert hits >= 0.9 * total


def test_search_is_routed_at_every_size(spark, monkeypatch):
    random = np.random.default_rng(6)
    x = np.array([v for _ in range(24) for v in family(random, 16, 50, 0.5)])
    built = []

    class Watched(vector_search.Index):
        def __init__(self, *of):
            super().__init__(*of)
            built.append(self)

    monkeypatch.setattr(vector_search, "Index", Watched)
    for per_part, parts in ((vector_search.PER_PART, 2), (150, 8)):
        monkeypatch.setattr(vector_search, "PER_PART", per_part)
        got = {}
        for r in vector_search.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        index = built.pop()
        assert not built and index.router(x).shape[1] == parts
        assert parts == 2 or index.ask < parts
        asked = np.arange(0, len(x), 20)
        near = vector_search.neighbours(x, asked, 20)
        assert set(got) == set(asked.tolist()) and all(len(v) == 20 for v in got.values())
        assert sum(len(got[q] & set(n)) for q, n in zip(asked.tolist(), near.tolist(), strict=True)) >= 0.9 * near.size


def test_learned_partitions_are_balanced_and_find_neighbours():
    random = np.random.default_rng(2)
    x = np.array([v for _ in range(60) for v in family(random, 24, 60, 0.6)])
    index = vector_search.Index(x, 160_000, 20, 0.95)
    part = vector_search.balanced_parts(x, vector_search.neighbours(x, np.arange(len(x)), 8), 8)
    assert np.bincount(part).max() <= 1.06 * len(x) / 8
    asked = np.arange(0, len(x), 20)
    p = index.router(x / np.linalg.norm(x, axis=1, keepdims=True))
    own, visited = p.argmax(axis=1), np.argsort(-p[asked], axis=1)[:, : index.ask]
    near = vector_search.neighbours(x, asked, 20)
    met = (own[near][:, :, None] == visited[:, None, :]).any(axis=2).mean()
    assert met >= 0.9 and index.ask < p.shape[1]


def test_traversal_is_in_order_and_complete():
    random = np.random.default_rng(3)
    a, b = random.random(12), random.random(9)
    found = list(traverse(a, b, 0.7))
    cost = [a[i] ** 2 + b[j] ** 2 for i, j in found]
    assert cost == sorted(cost) and set(found) == {(i, j) for i in range(12) for j in range(9) if a[i] ** 2 + b[j] ** 2 <= 0.49}


def test_links_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK_BYTES", 8_000)
    test_links_against_all_pairs(spark)


def test_a_vector_is_sent_for_each_block_not_for_each_cell(spark, monkeypatch):
    """Random vectors ask many cells; no table that is kept has a row for each."""
    x = np.random.default_rng(8).standard_normal((3_000, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    kept, store = [], vector_links.materialize
    monkeypatch.setattr(vector_links, "materialize", lambda df: kept.append(store(df)) or kept[-1])
    assert vector_links.links(table).where("n_links = 0").count() == 3_000
    assert max(t.count() for t in kept) <= 3_000


def test_asking_in_bulk_is_the_traversal():
    x = vector_links.unit(np.random.default_rng(4).standard_normal((700, 16)))
    index = vector_links.Index(x, 2_000, 0.95, 0.99)
    i, j, a, b = index.place(x)
    width = len(index.words[1])
    asked = {(k, p, q) for k in range(len(x)) for p, q in traverse(a[k], b[k], index.walk)}
    called = set()
    for p in range(len(index.words[0])):
        for q, who in enumerate(index.callers(a**2, b.T**2, p, np.arange(width))):
            called |= {(int(k), p, q) for k in who}
    assert called == asked and (index.cell(x) == i * width + j).all()
    p, q = (np.random.default_rng(k).integers(0, len(w), len(x)) for k, w in enumerate(index.words))
    at = np.arange(len(x))
    assert np.allclose(index.way(x, index.cell(x), p * width + q), a[at, p] ** 2 + b[at, q] ** 2)


def test_merge_is_the_smallest_of_each_piece():
    random = np.random.default_rng(9)
    tree, owner = np.arange(60), {i: {i} for i in range(60)}
    for _ in range(4):
        a, b = random.integers(0, 60, (2, 12))
        tree = merge(tree, a, b)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            both = owner[i] | owner[j]
            owner |= dict.fromkeys(both, both)
        assert tree.tolist() == [min(owner[i]) for i in range(60)]


def test_empty_tables(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert vector_links.links(table).collect() == [] and vector_search.search(table).collect() == []
    only = spark.createDataFrame(ODD[:6], SCHEMA)
    assert len(vector_links.links(only).collect()) == 6 and vector_search.search(only).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert got[300] == got[301] == 300 and 200 not in got
