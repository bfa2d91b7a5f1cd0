"""Round trips through files, and the operators that meet rows by time or by value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.modelling.model import submission
from antecede.operators.timeline import asof_row, rule_at_or_above
from antecede.plans import features as X
from antecede.plans.matrix import LABEL
from antecede.session import work_folder
from antecede.sources import (
    EVENT_SCHEMA,
    load,
    read_events,
    read_template,
    read_with_quarantine,
    rows_of_days,
    with_file_order,
    write_by_date,
    write_events,
    write_in_order,
    write_submission,
)
from catalog.adapter import ROLES, event_log, over_log
from catalog.features import CLIPS_SQL, X5_SQL

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


def _path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _as_file(spark: SparkSession, sf: str) -> DataFrame:
    """The log with the column types of an event file."""
    log = event_log(spark, sf)
    return log.withColumns({"installation_id": F.col("installation_id").cast("string"), "ts": F.col("ts").cast("timestamp"), "world": F.col("world2")})


PRESENT = [f.name for f in EVENT_SCHEMA if f.name != "game_time"]


@query(
    "csv_events",
    over_log(
        """SELECT event_id, game_session, ts, event_data, installation_id::VARCHAR AS installation_id, event_count, event_code, title, type,
             world2 AS world FROM log"""
    ),
)
def _(spark, sf):
    """The log written as CSV and read back: quotes in payloads, microseconds and ids that look like numbers survive."""
    path = _path(spark, "events")
    write_events(_as_file(spark, sf), path)
    return read_events(spark, path, PRESENT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "csv_bad_lines",
    """SELECT event_id::VARCHAR AS row, event_id % 97 < 3 AS bad FROM events""",
)
def _(spark, sf):
    """Lines of an event file of which some are spoilt (a field that is no number, too few fields, too many), and where they end up."""
    log = _as_file(spark, sf).select(F.col("row_id").cast("string").alias("event_id"), "game_session", "ts", "event_data", "installation_id", "event_count", "row_id")
    quoted = F.concat(F.lit('"'), F.replace("event_data", F.lit('"'), F.lit('""')), F.lit('"'))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    count = F.when(F.col("row_id") % 97 == 0, "twelve").otherwise(F.col("event_count").cast("string"))
    fields = [F.col("event_id"), F.col("game_session"), stamp, quoted, F.col("installation_id"), count]
    line = F.concat_ws(",", *fields)
    line = F.when(F.col("row_id") % 97 == 1, F.concat_ws(",", *fields[:4])).when(F.col("row_id") % 97 == 2, F.concat(line, F.lit(",more"))).otherwise(line)
    path = _path(spark, "lines")
    log.select(line.alias("line")).write.option("lineSep", "\n").text(path)
    present = ["event_id", "game_session", "timestamp", "event_data", "installation_id", "event_count"]
    good, bad = read_with_quarantine(spark, path, EVENT_SCHEMA, present, header=False)
    return good.select(F.col("event_id").alias("row"), F.lit(False).alias("bad")).union(
        bad.select(F.substring_index("line", ",", 1), F.lit(True))
    )


@query(
    "submission_csv",
    over_log(
        """SELECT row_number() OVER (ORDER BY md5(u.installation_id::VARCHAR)) - 1 AS place, u.installation_id::VARCHAR AS installation_id,
             CAST(coalesce(b.class, 0) AS INT) AS accuracy_group
           FROM (SELECT DISTINCT installation_id FROM log) u LEFT JOIN b USING (installation_id)""",
        X5_SQL,
        """b AS (SELECT installation_id, list_position(s, list_max(s)) - 1 AS class FROM
             (SELECT installation_id, [count(*) FILTER (accuracy_group = 0), count(*) FILTER (accuracy_group = 1),
                count(*) FILTER (accuracy_group = 2), count(*) FILTER (accuracy_group = 3)] AS s
              FROM anchors JOIN x5 USING (game_session) GROUP BY 1))""",
    ),
)
def _(spark, sf):
    """A template file in an order of its own; the answer's files, read back in order, have the same."""
    log = event_log(spark, sf).withColumn("installation_id", F.col("installation_id").cast("string"))
    template = _path(spark, "template")
    users = log.select("installation_id", F.lit(0).alias("accuracy_group")).distinct().withColumn("by", F.md5("installation_id"))
    write_in_order(users, template, ["by"], ["installation_id", "accuracy_group"])
    past = log.where(ROLES.is_anchor()).select("installation_id", "game_session").join(X.x5(log, ROLES).select("game_session", LABEL), "game_session")
    votes = past.groupBy("installation_id").agg(F.array(*[F.count(F.when(F.col(LABEL) == g, 1)) for g in range(4)]).alias("scores"))
    asked = with_file_order(read_template(spark, template))
    out = _path(spark, "submission")
    write_submission(submission(votes, asked, default=0, carry=["place"]), out, order=["place"])
    return with_file_order(read_template(spark, out))


@query(
    "asof_row",
    """WITH r AS (SELECT user_id, ts, max(event_id) AS clicked, arg_max(value, event_id) AS worth FROM events WHERE event_type = 'click' GROUP BY ALL),
       p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
       SELECT p.event_id, CASE WHEN near THEN r.clicked END AS clicked, CASE WHEN near THEN r.worth END AS worth, CASE WHEN near THEN r.ts END AS clicked_at
       FROM (SELECT p.event_id, r.clicked, r.worth, r.ts, p.ts - r.ts <= INTERVAL 6 HOUR AS near FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts > r.ts) q
       JOIN p USING (event_id) LEFT JOIN r ON r.user_id = p.user_id AND r.clicked = q.clicked""",
)
def _(spark, sf):
    """Each purchase with its user's last click of the six hours before."""
    events = load(spark, sf, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("clicked"), F.col("value").alias("worth"))
    met = asof_row(purchases, clicks, ["user_id"], ["clicked", "worth"], ties=["clicked"], tolerance_seconds=6 * 3600)
    return met.select("event_id", "asof.clicked", "asof.worth", F.col("asof.ts").alias("clicked_at"))


#: Steps of scores, a different number for each title.
STEPS = [
    ("view_t0", 600.0, 0), ("view_t0", 7200.0, 1), ("view_t0", 86400.0, 2), ("view_t0", 259200.0, 1),
    ("view_t1", 43200.0, 3), ("view_t2", 7200.0, 0), ("view_t2", 172800.0, 5), ("click_t0", 1.0, 9),
]
STEPS_SQL = "steps(title, threshold, score) AS (VALUES {})".format(", ".join(f"('{t}', {v}::DOUBLE, {s})" for t, v, s in STEPS))


@query(
    "bucket_by_table",
    over_log(
        """SELECT installation_id, ts, title, coalesce((SELECT arg_min(s.score, s.threshold) FROM steps s
             WHERE s.title = c.title AND s.threshold >= c.duration), 0)::INT AS bucket FROM clips c""",
        CLIPS_SQL, STEPS_SQL,
    ),
)
def _(spark, sf):
    """Clip durations scored by a table of steps."""
    clips = X.x6_clips(event_log(spark, sf), ROLES).select("installation_id", "ts", "title", "duration")
    rules = spark.createDataFrame(STEPS, "title string, threshold double, score int")
    return rule_at_or_above(clips, rules, "title", "duration", width=3600.0).select("installation_id", "ts", "title", "bucket")


@query(
    "scan_pruned",
    """SELECT event_id, ts, user_id, event_type FROM events
       WHERE ts::DATE IN (SELECT ts::DATE FROM events WHERE event_type = 'purchase' AND value > 250)""",
)
def _(spark, sf):
    """All events of the days on which a large purchase was made, from a log stored by day."""
    events, path = load(spark, sf, "events"), _path(spark, "by-day")
    write_by_date(events.select("event_id", "ts", "user_id", "event_type", "value"), path)
    log = spark.read.parquet(path)
    large = log.where("event_type = 'purchase' AND value > 250").select("date")
    return rows_of_days(log, large).select("event_id", "ts", "user_id", "event_type")
