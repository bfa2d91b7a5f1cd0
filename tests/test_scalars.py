import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.functions import (
    accuracy_group,
    argmax,
    bucket_by_rule,
    has_xy,
    hour_dow,
    json_flag,
    json_int,
    map_category,
    micros,
    ratio,
    seconds_between,
    slug,
    slugs,
)
from antecede.operators.frames import align_to, category_values, fill_max
from antecede.plans import constants as C
from antecede.plans.eligibility import label_worlds, with_world


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_correct_flag_keeps_case_and_takes_the_first(spark):
    texts = ['{"correct":true}', '{"correct":TRUE}', '{"CORRECT":false,"correct":true}', '{"k":1}']
    got = one(spark, "t string", [(t,) for t in texts], json_flag(F.col("t"), "correct"))
    assert got == [("true",), ("TRUE",), ("false",), ("",)]


def test_click_coordinates(spark):
    texts = ['{"x":12,"y":34}', '{"y":3,"x":4}', '{"x":-5,"y":6}', '{"x":7.9,"y":8.2}', '{"x":1,"x":2,"y":9}']
    got = one(
        spark, "t string", [(t,) for t in texts],
        has_xy(F.col("t")), json_int(F.col("t"), "x"), json_int(F.col("t"), "y"),
    )
    assert got == [(True, 12, 34), (False, 4, 3), (False, None, 6), (True, 7, 8), (True, 1, 9)]


def test_weekday_counts_from_monday(spark):
    times = [(dt.datetime(2024, 1, 1, 23, 5),), (dt.datetime(2024, 1, 7, 0, 0),), (dt.datetime(1969, 12, 31, 22, 59),)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(times, f"t {kind}")
        assert [tuple(r) for r in df.select(*hour_dow(df, "t")).collect()] == [(23, 0), (0, 6), (22, 2)]


def test_hour_and_weekday_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_seconds(1704151800) AS t")  # 2024-01-01 23:30 UTC, a Monday
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("Asia/Seoul", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert tuple(df.select(*hour_dow(df, "t")).first()) == (23, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_fractional_seconds_for_both_timestamp_types(spark):
    a, b = dt.datetime(2024, 1, 1, 0, 0, 0, 250000), dt.datetime(2024, 1, 1, 0, 0, 1, 0)
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
        assert df.select(seconds_between("a", "b")).first()[0] == 0.75
        assert df.select(F.expr(micros(df, "a"))).first()[0] == 1704067200250000


def test_accuracy_groups(spark):
    got = one(spark, "a double", [(1.0,), (0.5,), (0.49,), (0.0,)], accuracy_group(F.col("a")))
    assert got == [(3,), (2,), (1,), (0,)]


def test_ratio_of_nothing_is_null(spark):
    assert one(spark, "a int, b int", [(1, 0), (1, 2)], ratio(F.col("a"), F.col("b"))) == [(None,), (0.5,)]


def test_clip_rules_have_closed_upper_bounds_and_nothing_beyond(spark):
    rows = [("Rulers", s) for s in (0.5, 1.0, 1.5, 25.0, 126.0, 126.1)]
    got = one(spark, "t string, s double", rows, bucket_by_rule(F.col("s"), F.col("t"), C.CLIP_RULES))
    assert got == [(0,), (0,), (1,), (1,), (2,), (0,)]


def test_first_world_wins_and_an_unknown_title_takes_the_default(spark):
    df = spark.createDataFrame([("Chow Time",), ("Welcome to Lost Lagoon!",), ("Something",)], "title string")
    assert [r["world2"] for r in with_world(df).collect()] == ["CRYSTALCAVES1", None, "MAGMAPEAK"]
    twice = {"A": ("t",), "B": ("t",)}
    assert one(spark, "x string", [("t",)], map_category(F.col("x"), twice, "C")) == [("A",)]


def test_labels_default_to_another_world_than_titles(spark):
    rows = [("u", "Cauldron Filler (Assessment)"), ("u", "Chest Sorter (Assessment)"), ("u", "Chest Sorter (Assessment)")]
    got = label_worlds(spark.createDataFrame(rows, "installation_id string, title string")).collect()
    assert sorted(r["world2"] for r in got) == ["CRYSTALCAVES2", "MAGMAPEAK"]


def test_argmax_takes_the_first_of_equals(spark):
    got = one(spark, "s array<double>", [([0.1, 0.4, 0.4],), ([0.7, 0.1, 0.2],)], argmax(F.col("s")))
    assert got == [(1,), (0,)]


def test_slugs():
    assert slug("Heavy, Heavier, Heaviest") == "heavy_heavier_heaviest"
    assert slug("Pirate's Tale") == "pirate_s_tale" and slug(4100) == "4100"
    assert len({slug("게임"), slug("활동"), slug("")}) == 3 and slug("게임").isidentifier() is slug("활동").isidentifier()
    assert len(set(slugs(["a b", "a-b", "A b", "c"]))) == 4 and slugs(["x", "y"]) == ["x", "y"]


def test_align_takes_order_and_fills(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    out = align_to(df, ["a", "x", "b"])
    assert out.columns == ["a", "x", "b"] and tuple(out.first()) == (2, 0.0, 1)


def test_fill_max_of_own_and_of_another_frame(spark):
    df = spark.createDataFrame([(1, 3.0, None), (2, None, None)], "k int, a double, b double")
    other = spark.createDataFrame([(9.0, 8.0)], "a double, b double")
    assert sorted(tuple(r) for r in fill_max(df, ["a", "b"]).collect()) == [(1, 3.0, None), (2, 3.0, None)]
    assert sorted(tuple(r) for r in fill_max(df, ["a", "b"], other).collect()) == [(1, 3.0, 8.0), (2, 9.0, 8.0)]


def test_category_values_are_all_of_them(spark):
    df = spark.range(30_000).selectExpr("id % 12000 AS v")
    assert category_values(df, "v") == list(range(12_000))
