"""The provided ``events`` table read as an event log with sessions.

A session is one user's events of one type within five days; it has one title
and one world.  ``EVENT_LOG_SQL`` is the same mapping as plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.operators.timeline import numbered, with_slot
from antecede.plans.roles import Roles
from antecede.sources import load

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
TITLES = tuple(f"{t}_t{i}" for t in EVENT_TYPES if t != "purchase" for i in range(3))
CODES = (2000, 3010, 4070, 4100)

ROLES = Roles(
    submit_code_by_title={"purchase_t1": 4070},
    clip_start="type = 'Clip'",
    clip_rules={f"view_t{i}": (7200, 86400, 259200) for i in range(3)},
    attempt="type = 'Assessment' AND event_code = 2000",
    first_game={"click_1": "click one"},
    first_activity={"signup_2": "signup two"},
    help_game={f"click_{i}": f"click {i}" for i in range(3)},
    help_activity={"error_0": "error zero", "signup_3": "signup three"},
    titles=TITLES,
    codes=CODES,
    title_codes=tuple(f"{t}_{c}" for t in TITLES for c in CODES),
)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        "ts",
        "user_id",
        "event_type",
        F.regexp_extract("props", '"k": ?([0-9]+)', 1).cast("int").alias("k"),
        F.floor("value").cast("bigint").alias("x"),
        F.floor((F.day("ts") - 1) / 5).cast("int").alias("bucket"),
    )
    n = numbered(with_slot(raw), ["user_id", "event_type", "bucket"], ["ts", "row_id"], "event_count")
    k, kind, third = F.col("k"), F.col("event_type"), F.col("bucket") % 3
    return n.select(
        "row_id",
        F.col("user_id").alias("installation_id"),
        F.concat_ws("-", "user_id", "event_type", "bucket").alias("game_session"),
        "ts",
        F.col("event_count").cast("int").alias("event_count"),
        F.when(F.col("event_count") == 1, 2000).when(k >= 60, 4100).when(k >= 30, 4070).otherwise(3010)
        .alias("event_code"),
        F.concat(kind, F.lit("_"), (k % 4).cast("string")).alias("event_id"),
        F.concat(kind, F.lit("_t"), third.cast("string")).alias("title"),
        F.when(kind == "purchase", "Assessment").when(kind == "click", "Game").when(kind == "view", "Clip")
        .otherwise("Activity").alias("type"),
        F.when(third == 1, "W1").otherwise("W0").alias("world2"),
        F.when(k % 10 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).otherwise(
            F.concat(
                F.lit('{"correct":'), F.when(k % 2 == 0, "true").otherwise("false"),
                F.lit(',"x":'), F.col("x").cast("string"), F.lit(',"y":'), k.cast("string"), F.lit("}"),
            )
        ).alias("event_data"),
    )


def labelled(log: DataFrame) -> DataFrame:
    """The (user, world) pairs with a submitted assessment stand in for labels."""
    return log.where(ROLES.is_submit()).select("installation_id", "world2").distinct()


EVENT_LOG_SQL = """
e AS (
  SELECT event_id AS row_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INT) AS k,
         CAST(floor((day(ts) - 1) / 5) AS INT) AS bucket
  FROM events),
n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type, bucket
                                    ORDER BY ts, row_id) AS INT) AS event_count
  FROM e),
raw_log AS (
  SELECT row_id, user_id AS installation_id,
    concat(CAST(user_id AS STRING), '-', event_type, '-', CAST(bucket AS STRING)) AS game_session,
    ts, event_count,
    CASE WHEN event_count = 1 THEN 2000 WHEN k >= 60 THEN 4100
         WHEN k >= 30 THEN 4070 ELSE 3010 END AS event_code,
    concat(event_type, '_', CAST(k % 4 AS STRING)) AS event_id,
    concat(event_type, '_t', CAST(bucket % 3 AS STRING)) AS title,
    CASE event_type WHEN 'purchase' THEN 'Assessment' WHEN 'click' THEN 'Game'
         WHEN 'view' THEN 'Clip' ELSE 'Activity' END AS type,
    CASE WHEN bucket % 3 = 1 THEN 'W1' ELSE 'W0' END AS world2,
    CASE WHEN k % 10 = 0 THEN concat('{"k":', CAST(k AS STRING), '}')
         ELSE concat('{"correct":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
                     ',"x":', CAST(CAST(floor(value) AS BIGINT) AS STRING),
                     ',"y":', CAST(k AS STRING), '}') END AS event_data
  FROM n)
"""

ANCHORS_SQL = """
anchors AS (
  SELECT installation_id, world2, game_session, ts, title FROM log
  WHERE type = 'Assessment' AND event_code = 2000)
"""

SUBMIT_SQL = "type = 'Assessment' AND event_code = CASE WHEN title = 'purchase_t1' THEN 4070 ELSE 4100 END"

LABELLED_SQL = f"labelled AS (SELECT DISTINCT installation_id, world2 FROM raw_log WHERE {SUBMIT_SQL})"

TRAIN_SQL = f"""
feed AS (SELECT l.* FROM raw_log l JOIN labelled USING (installation_id, world2)),
log AS (
  SELECT * FROM feed
  WHERE type <> 'Assessment' OR game_session IN (SELECT game_session FROM feed WHERE {SUBMIT_SQL}))
"""

LAST_SQL = """
last_assessment AS (
  SELECT installation_id, world2, game_session, ts FROM raw_log WHERE type = 'Assessment'
  QUALIFY row_number() OVER (PARTITION BY installation_id
    ORDER BY ts DESC, event_count DESC, game_session DESC, event_id DESC, row_id DESC) = 1)
"""

TEST_SQL = """
log AS (SELECT l.* FROM raw_log l JOIN (SELECT installation_id, world2 FROM last_assessment) USING (installation_id, world2)
)
"""


def over_log(body: str, *ctes: str) -> str:
    """A query on the whole log."""
    return f"WITH {', '.join([EVENT_LOG_SQL, 'log AS (SELECT * FROM raw_log)', ANCHORS_SQL, *ctes])} {body}"


def over_train(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([EVENT_LOG_SQL, LABELLED_SQL, TRAIN_SQL, ANCHORS_SQL, *ctes])} {body}"


def over_test(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([EVENT_LOG_SQL, LAST_SQL, TEST_SQL, ANCHORS_SQL, *ctes])} {body}"
