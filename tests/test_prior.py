"""The prior table against brute force."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from antecede.operators.prior import Cell, Family, prior_table

START = dt.datetime(2024, 1, 1)
ROW = "installation_id string, world2 string, ts timestamp, title string, v double"
ANCHOR = "installation_id string, world2 string, ts timestamp, game_session string"
LABELS = ("A b", "C's")


def at(second):
    return START + dt.timedelta(seconds=second)


def table(spark, rows, anchors, dense=True, slot=3600, parts=3):
    r = spark.createDataFrame(rows, ROW).repartition(parts)
    a = spark.createDataFrame(anchors, ANCHOR).repartition(parts)
    cells = (
        Cell("x", ("n", "s", "q", "max", "any"), F.col("title"), LABELS),
        Cell("all", ("n",)),
        Cell("first", ("n",), when=F.col("title") == LABELS[0]),
    )
    family = Family("f", r, cells, by=("title",), value=F.col("v"), dense=dense)
    return prior_table(a, [family], slot_seconds=slot)


def check(got, rows, anchors):
    got = {r["game_session"]: r for r in got.collect()}
    assert len(got) == len(anchors)
    for user, world, ts, session in anchors:
        mine = [r for r in rows if r[:2] == (user, world)]
        before = [r for r in mine if r[2] < ts]
        state = got[session]
        assert state["all_n"] == len(before)
        assert state["first_n"] == sum(r[3] == LABELS[0] for r in before)
        for label, g in zip(LABELS, ("a_b", "c_s")):
            values = [r[4] for r in before if r[3] == label]
            assert state[f"x_n__{g}"] == len(values)
            assert state[f"x_s__{g}"] == sum(values)
            assert state[f"x_q__{g}"] == sum(v * v for v in values)
            assert state[f"x_max__{g}"] == (max(values) if values else None)
            assert state[f"x_any__{g}"] == sum(r[3] == label for r in mine)


def sample(seed, n_rows, n_anchors, span):
    rnd = random.Random(seed)
    users = ["hot"] * 5 + ["u1", "u2"]
    rows = [
        (rnd.choice(users), rnd.choice("vw"), at(rnd.randrange(span)), rnd.choice(LABELS), float(rnd.randrange(9)))
        for _ in range(n_rows)
    ]
    anchors = [(rnd.choice([*users, "none"]), rnd.choice("vw"), at(rnd.randrange(span)), f"s{i}") for i in range(n_anchors)]
    return rows, anchors


@pytest.mark.parametrize("dense,slot,span", [(True, 3600, 40000), (False, 3600, 40000), (True, 60, 900), (True, 86400, 50)])
def test_equals_brute_force_with_ties_and_a_hot_key(spark, dense, slot, span):
    rows, anchors = sample(span + dense, 800, 120, span)
    check(table(spark, rows, anchors, dense, slot), rows, anchors)


def test_equal_instants_are_not_earlier(spark):
    rows = [("u", "w", at(10), LABELS[0], 1.0), ("u", "w", at(9), LABELS[0], 2.0)]
    anchors = [("u", "w", at(10), "s1"), ("u", "w", at(10), "s2"), ("u", "w", at(9), "s3")]
    got = {r["game_session"]: r["all_n"] for r in table(spark, rows, anchors).collect()}
    assert got == {"s1": 1, "s2": 1, "s3": 0}


def test_rows_only_after_the_last_anchor_count_for_totals_alone(spark):
    rows = [("u", "w", at(90_000), LABELS[1], 4.0)]
    (got,) = table(spark, rows, [("u", "w", at(5), "s")]).collect()
    assert got["x_n__c_s"] == 0 and got["x_any__c_s"] == 1 and got["x_max__c_s"] is None


def test_no_rows_and_no_anchors(spark):
    (got,) = table(spark, [], [("u", "w", at(5), "s")]).collect()
    assert got["all_n"] == 0 and got["x_any__a_b"] == 0
    assert table(spark, [("u", "w", at(1), LABELS[0], 1.0)], []).count() == 0


def test_input_order_does_not_matter(spark):
    rows, anchors = sample(8, 300, 40, 20000)
    one = sorted(map(str, table(spark, rows, anchors, parts=1).collect()))
    two = sorted(map(str, table(spark, rows[::-1], anchors[::-1], parts=4).collect()))
    assert one == two


def test_later_rows_change_nothing(spark):
    rows, anchors = sample(9, 200, 20, 5000)
    later = [(u, w, at(9000 + i), LABELS[0], 5.0) for i, (u, w, *_rest) in enumerate(rows)]
    drop = ("x_any__a_b", "x_any__c_s")
    one = sorted(map(str, table(spark, rows, anchors).drop(*drop).collect()))
    assert one == sorted(map(str, table(spark, rows + later, anchors).drop(*drop).collect()))


def test_two_families_share_one_table(spark):
    rows, anchors = sample(4, 200, 30, 8000)
    r, a = spark.createDataFrame(rows, ROW), spark.createDataFrame(anchors, ANCHOR)
    counts = Family("c", r, (Cell("c", ("n",), F.col("title"), LABELS),), by=("title",))
    last = Family("l", r, (Cell("l", ("max",)),), value=F.col("_t"), dense=False)
    got = {x["game_session"]: x for x in prior_table(a, [counts, last]).collect()}
    for user, world, ts, session in anchors:
        before = [x for x in rows if x[:2] == (user, world) and x[2] < ts]
        assert got[session]["c_n__a_b"] == sum(x[3] == LABELS[0] for x in before)
        newest = max((x[2] for x in before), default=None)
        micros = newest and (newest - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert got[session]["l_max"] == micros


def test_labels_that_slug_alike_get_columns_of_their_own():
    names = [out for _, _, out in Cell("x", ("n",), F.col("title"), ("a b", "a-b", "게임", "활동", "c")).columns()]
    assert len(set(names)) == 5 and names[-1] == "x_n__c"


def test_means_count_values_and_not_rows(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("u", "w", at(1), 4.0), ("u", "w", at(2), None)], "installation_id string, world2 string, ts timestamp_ntz, v double")
    anchor = spark.createDataFrame([("u", "w", "s", at(3), "t")], "installation_id string, world2 string, game_session string, ts timestamp_ntz, title string")
    (got,) = prior_table(anchor, [Family("r", rows, (Cell("v", ("n", "c", "s")),), value=F.col("v"))]).collect()
    assert (got["v_n"], got["v_c"], got["v_s"]) == (2, 1, 4)


def test_the_plan_pairs_nothing(spark):
    rows, anchors = sample(4, 50, 10, 8000)
    plan = table(spark, rows, anchors)._jdf.queryExecution().optimizedPlan().toString()
    assert "_seg" in plan and "Cartesian" not in plan
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("<" in line or ">" in line for line in joins)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["u", "v"]), st.integers(0, 30), st.sampled_from(LABELS)), max_size=25),
    st.lists(st.tuples(st.sampled_from(["u", "v"]), st.integers(0, 30)), min_size=1, max_size=8),
)
def test_any_small_log(spark, raw, marks):
    rows = [(u, "w", at(s), t, float(s % 4)) for u, s, t in raw]
    anchors = [(u, "w", at(s), f"s{i}") for i, (u, s) in enumerate(marks)]
    check(table(spark, rows, anchors, slot=7), rows, anchors)


def test_one_user_with_many_hours_and_labels(spark):
    """Spans are crossed, and nothing but one row per slot or span meets by the bare key."""
    rnd = random.Random(11)
    names = tuple(f"l{i}" for i in range(30))
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("u", "w", at(rnd.randrange(400 * 3600)), rnd.choice(names), float(rnd.randrange(9))) for _ in range(3000)]
    marks = [("u", "w", f"s{i}", at(rnd.randrange(400 * 3600)), "t") for i in range(60)]
    r = spark.createDataFrame(rows, "installation_id string, world2 string, ts timestamp_ntz, label string, v double")
    a = spark.createDataFrame(marks, "installation_id string, world2 string, game_session string, ts timestamp_ntz, title string")
    family = Family("f", r, (Cell("c", ("n", "s", "max", "any"), F.col("label"), names),), by=("label",), value=F.col("v"))
    out = prior_table(a, [family])
    got = {x["game_session"]: x for x in out.collect()}
    for _, _, session, ts, _ in marks:
        for name in names:
            before = [x[4] for x in rows if x[2] < ts and x[3] == name]
            assert got[session][f"c_n__{name}"] == len(before) and got[session][f"c_s__{name}"] == sum(before)
            assert got[session][f"c_max__{name}"] == max(before, default=None)
            assert got[session][f"c_any__{name}"] == sum(x[3] == name for x in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_t#" not in "".join(line for line in plan.splitlines() if "Window" in line)  # the tape's window ran once, before
