"""What NULLs and large numbers do: the same features over logs with holes, derived in the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import slug
from antecede.modelling.prep import folds
from antecede.operators.prior import Cell, Family, prior_table
from antecede.plans import features as X
from antecede.plans.eligibility import anchors, eligible_train
from antecede.plans.matrix import LABEL, train_matrix
from antecede.session import materialize
from catalog.adapter import ANCHORS_SQL, EVENT_LOG_SQL, ROLES, TITLES, event_log, labelled, over_log
from catalog.features import DROP_KEYS, SAME_KEY, TRAIN_MATRIX_SQL, X1_SQL, X5_SQL, X9_SQL, counts_sql, rounded

QUERIES, ORACLES = {}, {}
TITLE_SQL = "concat(event_type, '_t', CAST(bucket % 3 AS STRING)) AS title"
BLANK_SQL = "CASE WHEN event_type = 'purchase' AND row_id % 4 = 0 THEN NULL ELSE concat(event_type, '_t', CAST(bucket % 3 AS STRING)) END AS title"


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


def over_holes(body: str, holes: str, *ctes: str) -> str:
    """A query on the log with some columns replaced."""
    log = f"log AS (SELECT * REPLACE ({holes}) FROM raw_log)"
    return f"WITH {', '.join([EVENT_LOG_SQL, log, ANCHORS_SQL, *ctes])} {body}"


def untitled(log: DataFrame) -> DataFrame:
    """Every fourth assessment row has no title."""
    blank = (F.col("type") == "Assessment") & (F.col("row_id") % 4 == 0)
    return log.withColumn("title", F.when(~blank, F.col("title")))


@query("matrix_null_title", TRAIN_MATRIX_SQL.replace(TITLE_SQL, BLANK_SQL))
def _(spark, sf):
    log = untitled(event_log(spark, sf))
    return rounded(train_matrix(materialize(eligible_train(log, labelled(log), ROLES)), ROLES))


@query(
    "x9_null_title",
    over_holes("SELECT game_session, count FROM x9", "CASE WHEN type = 'Assessment' AND row_id % 4 = 0 THEN NULL ELSE title END AS title", X9_SQL),
)
def _(spark, sf):
    return X.x9(untitled(event_log(spark, sf)), ROLES)


NO_THIRD = "CASE WHEN row_id % 3 = 0 THEN NULL ELSE title END AS title, CASE WHEN row_id % 7 = 0 THEN NULL ELSE event_id END AS event_id"


@query(
    "x3_null_title",
    over_holes(
        f"SELECT * {DROP_KEYS} FROM x3", NO_THIRD,
        counts_sql("x3", "r.title || '_' || CAST(r.event_code AS VARCHAR)", ROLES.title_codes, "true").replace("count(*)", "count(r.event_id)"),
    ),
)
def _(spark, sf):
    log = event_log(spark, sf).withColumns({
        "title": F.when(F.col("row_id") % 3 != 0, F.col("title")), "event_id": F.when(F.col("row_id") % 7 != 0, F.col("event_id")),
    })
    return X.x3(log, ROLES)


@query(
    "folds_null_label",
    over_log(
        """SELECT game_session, label, CAST((row_number() OVER (PARTITION BY label
             ORDER BY md5('42|' || game_session), game_session) - 1) % 10 AS INT) AS fold
           FROM (SELECT game_session, nullif(accuracy_group, 3) AS label FROM x5)""",
        X5_SQL,
    ),
)
def _(spark, sf):
    rows = X.x5(event_log(spark, sf), ROLES).select("game_session", F.expr(f"nullif({LABEL}, 3)").alias("label"))
    return folds(rows, "label", "game_session")


@query(
    "prior_mean_nulls",
    over_holes(
        f"""SELECT a.game_session, count(*) AS n, count(r.event_count) AS n_values, round(avg(r.event_count), 6) AS mean
            FROM anchors a JOIN log r ON {SAME_KEY} AND a.ts > r.ts WHERE r.type <> 'Assessment' GROUP BY 1""",
        "CASE WHEN row_id % 3 = 0 THEN NULL ELSE event_count END AS event_count",
    ),
)
def _(spark, sf):
    log = event_log(spark, sf)
    rows = log.where(~ROLES.is_assessment()).select(
        "installation_id", "world2", "ts", F.when(F.col("row_id") % 3 != 0, F.col("event_count")).alias("v")
    )
    state = prior_table(anchors(log, ROLES), [Family("rows", rows, (Cell("v", ("n", "c", "s")),), value=F.col("v"))])
    return state.where("v_n > 0").selectExpr(
        "game_session", "CAST(v_n AS BIGINT) AS n", "CAST(v_c AS BIGINT) AS n_values", "round(try_divide(v_s, v_c), 6) AS mean"
    )


LARGE = 1_000_000_000


def _large_sql() -> str:
    frame = "OVER (PARTITION BY installation_id, title ORDER BY ts, game_session ROWS UNBOUNDED PRECEDING)"
    parts = []
    for g in map(slug, TITLES):  # the spread of a count is that of the count less any number
        parts.append(f"round(avg(x1_cnt__{g}) {frame} + {LARGE}, 4) AS x1_mean__{g}")
        parts.append(f"round(coalesce(stddev_samp(x1_cnt__{g}) {frame}, 0), 6) AS x1_std__{g}")
    return f"SELECT game_session, {', '.join(parts)} FROM x1"


@query("running_std_large", over_log(_large_sql(), X1_SQL))
def _(spark, sf):
    """Running mean and deviation of counts of about 1e9."""
    log = event_log(spark, sf)
    state = prior_table(anchors(log, ROLES), [X.activity(log, ROLES, ["x1"])]).where("x1_all_n > 0")
    groups = [slug(t) for t in TITLES]
    large = state.withColumns({f"x1_n__{g}": F.col(f"x1_n__{g}") + LARGE for g in groups})
    out = X.running(large, {"x1": ("true", groups)})
    return out.select(
        "game_session", *[F.round(f"x1_mean__{g}", 4).alias(f"x1_mean__{g}") for g in groups],
        *[F.round(f"x1_std__{g}", 6).alias(f"x1_std__{g}") for g in groups],
    )
