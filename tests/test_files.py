"""Quarantine, files in order, logs by day."""

import datetime as dt

from pyspark.sql import functions as F

from antecede.modelling.sketch import rank_error, rank_errors, read_sketches, robust_fit_sketch, sketch_quantiles, sketches, store_sketches
from antecede.sources import LABEL_SCHEMA, read_events, read_template, read_with_quarantine, rows_of_days, with_file_order, write_by_date, write_events, write_in_order

LABEL = "game_session,installation_id,title,num_correct,num_incorrect,accuracy,accuracy_group\n"


def test_lines_that_do_not_fit_are_set_aside(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(
        LABEL + 'a,u,T,1,0,1.0,3\nb,u,"quoted, ""title""",1,0,0.5,\nc,u,T,one,0,1.0,3\nd,u,T\ne,u,T,1,0,1.0,3,9\n,,,,,,\nf,u,T,1,0,1.0,3\n'
    )
    good, bad = read_with_quarantine(spark, str(path), LABEL_SCHEMA)
    assert [r.game_session for r in good.collect()] == ["a", "b", None, "f"]
    assert good.where("game_session = 'b'").first().title == 'quoted, "title"'
    assert sorted(r.line for r in bad.collect()) == ["c,u,T,one,0,1.0,3", "d,u,T", "e,u,T,1,0,1.0,3,9"]
    assert bad.first().file.endswith("labels.csv")
    clean, none = read_with_quarantine(spark, str(path), LABEL_SCHEMA, ["game_session"])
    assert clean.columns == ["game_session"] and none.count() == 7  # one field is expected, the lines have more


def test_logs_survive_csv(spark, tmp_path):
    at = dt.datetime(2020, 2, 29, 1, 2, 3, 456789)
    rows = [("e", "s", at, '{"a":"x,\\"y\\""}\nnext', "0001", 1), (None, "s", None, "", "u", None)]
    log = spark.createDataFrame(rows, "event_id string, game_session string, ts timestamp, event_data string, installation_id string, event_count int")
    log = log.withColumn("event_data", F.replace("event_data", F.lit("\n"), F.lit(" ")))
    write_events(log, f"{tmp_path}/log")
    got = read_events(spark, f"{tmp_path}/log", ["event_id", "game_session", "timestamp", "event_data", "installation_id", "event_count"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, log.withColumn("event_data", F.nullif("event_data", F.lit(""))).collect()))


def test_order_is_kept_over_many_files(spark, tmp_path):
    users = spark.range(5000).select(F.col("id").cast("string").alias("installation_id"), (F.col("id") % 4).cast("int").alias("accuracy_group"))
    by = users.withColumn("by", F.md5("installation_id")).repartition(7)
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "3000"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        write_in_order(by, f"{tmp_path}/t", ["by"], ["installation_id", "accuracy_group"])
        assert len(list((tmp_path / "t").glob("part-*.csv"))) > 1
        got = with_file_order(read_template(spark, f"{tmp_path}/t")).collect()  # a file is read in pieces
    finally:
        for name in small:
            spark.conf.unset(name)
    want = [r.installation_id for r in by.orderBy("by").collect()]
    assert sorted(r.place for r in got) == list(range(5000))
    assert [r.installation_id for r in sorted(got, key=lambda r: r.place)] == want


def test_only_the_days_of_the_anchors_are_read(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), "rare" if i in (30, 200) else "e") for i in range(240)]
    write_by_date(spark.createDataFrame(rows, "id int, ts timestamp, kind string"), f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    got = rows_of_days(log, log.where("kind = 'rare'").select("date"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan
    assert sorted(r.id for r in got.collect()) == [*range(24, 48), *range(192, 216)]
    back = rows_of_days(log, log.where("kind = 'rare'").select("date"), back=1)
    assert sorted(r.id for r in back.collect()) == [*range(0, 48), *range(168, 216)]


def test_sketches_of_days_merge(spark, tmp_path):
    days = spark.range(30_000).select(
        (F.col("id") % 7).cast("string").alias("day"), ((F.col("id") * 7919) % 30_000).cast("double").alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit(5.0)).when(F.col("id") % 3 == 0, F.lit(float("nan"))).alias("b"),
    )
    path = f"{tmp_path}/sketches"
    for part in ("day < '4'", "day >= '4'", "day = '2'"):  # the last one replaces a day
        store_sketches(sketches(days.where(part), ["a", "b"], F.col("day")), path)
    stored = read_sketches(spark, path)
    assert stored.count() == 14
    answers = sketch_quantiles(stored, [0.0, 0.1, 0.5, 0.9, 1.0])
    errors = rank_errors(days, answers).collect()
    assert len(errors) == 10 and all(r.error <= 2 * rank_error() for r in errors)
    assert {r.n for r in errors} == {30_000, 15_000}
    fitted = {r["col"]: r for r in robust_fit_sketch(stored).collect()}
    assert fitted["b"].median == 5.0 and fitted["b"].iqr == 1.0 and abs(fitted["a"].iqr - 15_000) < 30_000 * 4 * rank_error()
