"""Slot-wise operators against plain Python, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from antecede.operators.joins import keep_matching, spread_join, without_match
from antecede.operators.timeline import (
    asof_row,
    earliest_per_key,
    latest_per_key,
    numbered,
    previous_row,
    rule_at_or_above,
    running_sums,
    with_slot,
)

START = dt.datetime(2024, 1, 1)


def sample(seed, n=600):
    rnd = random.Random(seed)
    users = ["hot"] * 4 + ["a", "b"]
    return [
        (i, rnd.choice(users), START + dt.timedelta(seconds=rnd.randrange(40) * 600), rnd.randrange(10)) for i in range(n)
    ]


@pytest.fixture(scope="module")
def frame(spark):
    rows = sample(3)
    return rows, spark.createDataFrame(rows, "id int, user string, ts timestamp, v int").repartition(5)


def per_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("seconds", [600, 3600, 86400])
def test_numbered(frame, seconds):
    rows, df = frame
    got = {r["id"]: r["n"] for r in numbered(with_slot(df, "ts", seconds), ["user"], ["ts", "id"], "n").collect()}
    assert got == {r[0]: i for mine in per_user(rows).values() for i, r in enumerate(mine, 1)}


def test_previous_row_crosses_slots(frame):
    rows, df = frame
    out = previous_row(with_slot(df), ["user"], ["ts", "id"], ["id", "v"])
    got = {r["id"]: (tuple(r["prev"]) if r["prev"] else None) for r in out.collect()}
    expected = {}
    for mine in per_user(rows).values():
        for before, r in zip([None, *mine], mine):
            expected[r[0]] = (before[0], before[3]) if before else None
    assert got == expected


def test_running_sums(frame):
    rows, df = frame
    out = running_sums(with_slot(df), ["user"], ["ts", "id"], {"s": "CAST(v AS DOUBLE)", "n": "1D"})
    got = {r["id"]: (r["s"], r["n"]) for r in out.collect()}
    for mine in per_user(rows).values():
        total = 0
        for n, r in enumerate(mine, 1):
            total += r[3]
            assert got[r[0]] == (total, n)


def test_first_and_last_rows(frame):
    rows, df = frame
    firsts = {r["user"]: r["id"] for r in earliest_per_key(df, ["user"], ["ts", "id"], ["id"]).collect()}
    lasts = {r["user"]: r["id"] for r in latest_per_key(df, ["user"], ["ts", "id"], ["id"]).collect()}
    mine = per_user(rows)
    assert firsts == {u: m[0][0] for u, m in mine.items()} and lasts == {u: m[-1][0] for u, m in mine.items()}


def test_spread_joins_equal_plain_joins(spark, frame):
    rows, df = frame
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "user string, w int")
    for how in ("inner", "left"):
        for ways in (None, 5):
            got = sorted(map(str, spread_join(df, small, ["user"], how, ["id"], ways).select("id", "w").collect()))
            assert got == sorted(map(str, df.join(small, "user", how).select("id", "w").collect()))
    doubled = small.unionByName(small)
    assert keep_matching(df, doubled, ["user"]).count() == sum(r[1] in ("hot", "a") for r in rows)
    assert without_match(df, doubled, ["user"]).count() == sum(r[1] == "b" for r in rows)
    with pytest.raises(ValueError):
        spread_join(df, small, ["user"], "full", ["id"])


def test_a_hot_key_is_spread_over_tasks(spark):
    hot = spark.range(4000).selectExpr("id", "'hot' AS user")
    small = spark.createDataFrame([("hot", 1)], "user string, w int").hint("merge")
    out = spread_join(hot, small, ["user"], "inner", ["id"], ways=8).groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_null_keys_and_times_lose_no_row(spark):
    rows = [(1, None, 5), (2, None, 3), (3, "a", None), (4, "a", 7), (5, None, 10_000_000)]
    df = with_slot(spark.createDataFrame(rows, "id long, user string, s long").selectExpr("id", "user", "timestamp_seconds(s) AS ts"))
    got = {r["id"]: r["n"] for r in numbered(df, ["user"], ["ts", "id"], "n").collect()}
    assert got == {2: 1, 1: 2, 5: 3, 3: 1, 4: 2}
    before = {r["id"]: r["prev"] and r["prev"]["id"] for r in previous_row(df, ["user"], ["ts", "id"], ["id"]).collect()}
    assert before == {2: None, 1: 2, 5: 1, 3: None, 4: 3}
    sums = {r["id"]: r["total"] for r in running_sums(df, ["user"], ["ts", "id"], {"total": "CAST(id AS DOUBLE)"}).collect()}
    assert sums == {2: 2, 1: 3, 5: 8, 3: 3, 4: 7}


@pytest.mark.parametrize("seconds", [600, 7200, 10**6])
@pytest.mark.parametrize("strict,tolerance", [(True, None), (False, None), (True, 1200)])
def test_asof_row(spark, seconds, strict, tolerance):
    asked, rows = sample(5, 120), sample(6, 200)
    left = spark.createDataFrame([*asked, (900, None, START, 1), (901, "hot", None, 1)], "id int, user string, ts timestamp, v int").repartition(4)
    right = spark.createDataFrame([*rows, (800, None, START, 5), (801, "hot", None, 5)], "rid int, user string, ts timestamp, v int").repartition(3)
    got = {r.id: r.found for r in asof_row(left, right, ["user"], ["rid", "v"], ties=["rid"], tolerance_seconds=tolerance, strict=strict, slot_seconds=seconds, name="found").collect()}
    assert len(got) == 122 and got[900] is None and got[901] is None
    for i, user, ts, _ in asked:
        before = [r for r in rows if r[1] == user and (r[2] < ts or (r[2] == ts and not strict))]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        if best and tolerance and (ts - best[2]).total_seconds() > tolerance:
            best = None
        assert (got[i] and (got[i].rid, got[i].v, got[i].ts)) == (best and (best[0], best[3], best[2]))


@pytest.mark.parametrize("width", [0.5, 3.0, 1e6])
def test_rules_as_a_table(spark, width):
    rnd = random.Random(8)
    rules = [("hot", float(v), s) for s, v in enumerate(rnd.sample(range(60), 9))] + [("one", 4.0, 7), ("one", 4.0, 6), ("unused", 1.0, 1), (None, 3.0, 8)]
    rows = [(i, rnd.choice(["hot", "hot", "one", "none", None]), rnd.choice([rnd.uniform(-5, 70), float(rnd.randrange(60)), None, float("nan"), float("inf")])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label string, value double").repartition(5)
    table = spark.createDataFrame(rules, "label string, threshold double, score int")
    got = {r.id: r.bucket for r in rule_at_or_above(df, table, "label", "value", width, default=-1).collect()}
    for i, label, value in rows:
        fits = [(t, s) for name, t, s in rules if label is not None and name == label and value is not None and t >= value]
        assert got[i] == (min(fits)[1] if fits else -1), (label, value)


def test_rules_of_no_table(spark):
    df = spark.createDataFrame([("a", 1.0)], "label string, value double")
    none = spark.createDataFrame([], "label string, threshold double, score int")
    assert [tuple(r) for r in rule_at_or_above(df, none, "label", "value", 1.0).collect()] == [("a", 1.0, 0)]
