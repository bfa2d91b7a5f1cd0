"""The plain operators, each as one query over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import argmax, has_xy, json_flag, json_int, map_category
from antecede.operators.frames import align_to, fill_zero, pivot_wide, session_last_rows, value_share
from antecede.operators.joins import keep_matching, spread_join, without_match
from antecede.operators.prior import Cell, Family, prior_table
from antecede.operators.timeline import earliest_per_key, latest_per_key
from antecede.plans.eligibility import anchors
from antecede.sources import load
from catalog.adapter import LABELLED_SQL, ROLES, event_log, labelled, over_log

QUERIES, ORACLES = {}, {}

TYPES = ("Game", "Clip", "Assessment", "Activity")


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


def six(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


# ---- scans, projections, filters, scalars ---------------------------------------


@query("scan_events", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(spark, sf):
    return load(spark, sf, "events")


@query("proj_subset", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def _(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")


@query("proj_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(spark, sf):
    return load(spark, sf, "customer").drop("c_name", "c_mktsegment")


@query("proj_rename", "SELECT s_suppkey AS supplier, s_name AS name_x, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def _(spark, sf):
    return load(spark, sf, "supplier").withColumnsRenamed(
        {"s_suppkey": "supplier", "s_name": "name_x", "s_nationkey": "nation", "s_acctbal": "balance"}
    )


@query(
    "map_title_world",
    over_log(
        """SELECT row_id, title, CASE WHEN title IN ('click_t1', 'view_t1') THEN 'MIDDLE'
             WHEN title IN ('view_t1', 'error_t2') THEN 'END'
             WHEN title = 'signup_t0' THEN NULL ELSE 'REST' END AS world FROM log"""
    ),
)
def _(spark, sf):
    worlds = {"MIDDLE": ("click_t1", "view_t1"), "END": ("view_t1", "error_t2"), "": ("signup_t0",)}
    return event_log(spark, sf).select("row_id", "title", map_category(F.col("title"), worlds, "REST").alias("world"))


@query(
    "filter_type_code",
    over_log("SELECT row_id FROM log WHERE (type = 'Assessment' AND event_code = 4100) OR (type <> 'Clip' AND event_code = 2000)"),
)
def _(spark, sf):
    kind, code = F.col("type"), F.col("event_code")
    return event_log(spark, sf).where(((kind == "Assessment") & (code == 4100)) | ((kind != "Clip") & (code == 2000))).select("row_id")


@query("filter_isin", over_log("SELECT row_id, event_id FROM log WHERE event_id IN ('click_0', 'click_1', 'click_2')"))
def _(spark, sf):
    return event_log(spark, sf).where(F.col("event_id").isin(list(ROLES.help_game))).select("row_id", "event_id")


@query("filter_null", over_log("""SELECT row_id, event_data FROM log WHERE TRY_CAST(regexp_extract(event_data, '"x":([0-9]+)', 1) AS BIGINT) IS NULL"""))
def _(spark, sf):
    return event_log(spark, sf).where(json_int(F.col("event_data"), "x").isNull()).select("row_id", "event_data")


@query("str_concat", over_log("SELECT row_id, concat(title, '_', CAST(event_code AS VARCHAR)) AS title_code, concat(CAST(installation_id AS VARCHAR), '_', title) AS hap FROM log"))
def _(spark, sf):
    return event_log(spark, sf).select(
        "row_id",
        F.concat_ws("_", "title", "event_code").alias("title_code"),
        F.concat_ws("_", "installation_id", "title").alias("hap"),
    )


@query(
    "cast_roundtrip",
    over_log(
        """SELECT row_id, CAST(event_code AS VARCHAR) AS code_text, CAST(CAST(event_code AS VARCHAR) AS INT) AS code,
             TRY_CAST(regexp_extract(event_data, '"y":([0-9]+)', 1) AS BIGINT) AS y FROM log"""
    ),
)
def _(spark, sf):
    return event_log(spark, sf).select(
        "row_id",
        F.col("event_code").cast("string").alias("code_text"),
        F.col("event_code").cast("string").cast("int").alias("code"),
        json_int(F.col("event_data"), "y").alias("y"),
    )


@query("regex_correct", over_log("""SELECT row_id, regexp_extract(event_data, '"correct":([a-z]+)', 1, 'i') AS t_f FROM log"""))
def _(spark, sf):
    return event_log(spark, sf).select("row_id", json_flag(F.col("event_data"), "correct").alias("t_f"))


@query("regex_has_xy", over_log("""SELECT row_id FROM log WHERE regexp_matches(event_data, '("x":[0-9]+).+("y":[0-9]+)')"""))
def _(spark, sf):
    return event_log(spark, sf).where(has_xy(F.col("event_data"))).select("row_id")


@query(
    "regex_xy",
    over_log(
        """SELECT row_id, CAST(regexp_extract(event_data, '"x":([0-9]+)', 1) AS BIGINT) AS x,
             CAST(regexp_extract(event_data, '"y":([0-9]+)', 1) AS BIGINT) AS y
           FROM log WHERE regexp_matches(event_data, '("x":[0-9]+).+("y":[0-9]+)')"""
    ),
)
def _(spark, sf):
    data = F.col("event_data")
    return event_log(spark, sf).where(has_xy(data)).select("row_id", json_int(data, "x").alias("x"), json_int(data, "y").alias("y"))


@query(
    "argmax_class",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
         CAST(list_position([l_quantity / 50, l_discount * 10, l_tax * 12.5],
              list_max([l_quantity / 50, l_discount * 10, l_tax * 12.5])) - 1 AS INT) AS class
       FROM lineitem""",
)
def _(spark, sf):
    scores = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", argmax(scores).alias("class"))


@query(
    "fill_zero",
    over_log(
        """SELECT row_id, coalesce(TRY_CAST(regexp_extract(event_data, '"x":([0-9]+)', 1) AS BIGINT), 0) AS x,
             TRY_CAST(regexp_extract(event_data, '"y":([0-9]+)', 1) AS BIGINT) AS y FROM log"""
    ),
)
def _(spark, sf):
    data = F.col("event_data")
    return fill_zero(
        event_log(spark, sf).select("row_id", json_int(data, "x").alias("x"), json_int(data, "y").alias("y")), ["x"]
    )


@query(
    "schema_align",
    "SELECT s_suppkey, s_acctbal, 0.0::DOUBLE AS x1_cnt__absent, s_nationkey, 0.0::DOUBLE AS x2_cnt__absent FROM supplier",
)
def _(spark, sf):
    return align_to(load(spark, sf, "supplier"), ["s_suppkey", "s_acctbal", "x1_cnt__absent", "s_nationkey", "x2_cnt__absent"])


# ---- joins ----------------------------------------------------------------------


@query(
    "join_inner",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, o_custkey, o_orderpriority
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return lines.join(orders, "l_orderkey")


@query(
    "join_left",
    """SELECT c_custkey, coalesce(n, 0) AS n_orders, last_order FROM customer LEFT JOIN
         (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def _(spark, sf):
    per_customer = (
        load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    )
    return load(spark, sf, "customer").select("c_custkey").join(per_customer, "c_custkey", "left").fillna(0, ["n_orders"])


@query(
    "semi_user_world",
    over_log("SELECT row_id FROM log WHERE (installation_id, world2) IN (SELECT (installation_id, world2) FROM labelled)", LABELLED_SQL),
)
def _(spark, sf):
    log = event_log(spark, sf)
    return keep_matching(log, labelled(log), ["installation_id", "world2"]).select("row_id")


def _activity(log: DataFrame, *by: str) -> DataFrame:
    return log.where(~ROLES.is_assessment()).select("installation_id", "world2", "ts", *by)


@query(
    "prior_join",
    over_log(
        """SELECT a.game_session, count(*) AS n_prior, epoch_us(max(r.ts)) AS last_prior
           FROM anchors a JOIN log r ON a.installation_id = r.installation_id AND a.world2 = r.world2 AND a.ts > r.ts
           WHERE r.type <> 'Assessment' GROUP BY 1"""
    ),
)
def _(spark, sf):
    log = event_log(spark, sf)
    state = prior_table(anchors(log, ROLES), [Family("rows", _activity(log), (Cell("row", ("n", "max")),), value=F.col("_t"))])
    return state.where("row_n > 0").selectExpr(
        "game_session", "CAST(row_n AS BIGINT) AS n_prior", "CAST(row_max AS BIGINT) AS last_prior"
    )


@query(
    "prior_window",
    over_log(
        """SELECT game_session, coalesce(sum(n) FILTER (type = 'Game'), 0)::BIGINT AS game,
             coalesce(sum(n) FILTER (type = 'Clip'), 0)::BIGINT AS clip,
             coalesce(sum(n) FILTER (type = 'Activity'), 0)::BIGINT AS activity FROM c GROUP BY 1""",
        """c AS (SELECT a.game_session, r.type, count(r.row_id) AS n FROM anchors a LEFT JOIN log r
             ON a.installation_id = r.installation_id AND a.world2 = r.world2 AND a.ts > r.ts GROUP BY 1, 2)""",
    ),
)
def _(spark, sf):
    log = event_log(spark, sf)
    kinds = Cell("kind", ("n",), F.col("type"), ("Game", "Clip", "Activity"))
    state = prior_table(anchors(log, ROLES), [Family("rows", _activity(log, "type"), (kinds,), by=("type",))])
    return state.selectExpr("game_session", *[f"CAST(kind_n__{k} AS BIGINT) AS {k}" for k in ("game", "clip", "activity")])


@query(
    "anchors_without",
    over_log(
        """SELECT game_session FROM anchors WHERE (installation_id, world2) NOT IN
             (SELECT (installation_id, world2) FROM log WHERE event_id = 'click_1')"""
    ),
)
def _(spark, sf):
    log = event_log(spark, sf)
    found = log.where(F.col("event_id") == "click_1")
    return without_match(anchors(log, ROLES), found, ["installation_id", "world2"]).select("game_session")


@query(
    "session_last_row",
    over_log(
        """SELECT row_id, game_session, event_count FROM log WHERE type <> 'Assessment'
           QUALIFY rank() OVER (PARTITION BY game_session ORDER BY event_count DESC) = 1"""
    ),
)
def _(spark, sf):
    log = event_log(spark, sf)
    return session_last_rows(log.where(~ROLES.is_assessment())).select("row_id", "game_session", "event_count")


@query(
    "join_skewed",
    """SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    # nation is a fixed list of 25 rows; Spark sees its size and broadcasts it.
    return (
        spread_join(orders, customers, ["o_custkey"], "inner", ["o_orderkey"])
        .join(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
        .select("o_orderkey", "n_name")
    )


# ---- aggregations ---------------------------------------------------------------


@query("agg_count", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def _(spark, sf):
    per_order = load(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_order.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.count("l_orderkey").alias("n_orders"))


@query("agg_max", over_log("SELECT game_session, max(event_count) AS event_count, max(ts) AS ts FROM log GROUP BY 1"))
def _(spark, sf):
    return event_log(spark, sf).groupBy("game_session").agg(F.max("event_count").alias("event_count"), F.max("ts").alias("ts"))


@query(
    "agg_min",
    over_log("SELECT game_session, event_id, min(ts) AS ts, min(event_count) AS event_count FROM log GROUP BY 1, 2"),
)
def _(spark, sf):
    return event_log(spark, sf).groupBy("game_session", "event_id").agg(F.min("ts").alias("ts"), F.min("event_count").alias("event_count"))


@query("agg_mean", "SELECT l_suppkey, round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 6) AS price FROM lineitem GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_extendedprice"), 6).alias("price")
    )


# Prices have six digits before the point: four after it are what a double's sums can carry.
@query(
    "agg_std_samp",
    "SELECT o_custkey, o_orderstatus, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS spread FROM orders GROUP BY 1, 2",
)
def _(spark, sf):
    spread = F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0))
    return load(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.round(spread, 4).alias("spread"))


@query("agg_std_pop", "SELECT o_custkey, o_orderstatus, round(stddev_pop(o_totalprice), 4) AS spread FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.round(F.stddev_pop("o_totalprice"), 4).alias("spread")
    )


@query("agg_distinct", over_log("SELECT DISTINCT installation_id, title, event_code FROM log"))
def _(spark, sf):
    return event_log(spark, sf).select("installation_id", "title", "event_code").distinct()


ORDER_SQL = "ts, event_count, game_session, event_id, row_id"
ORDER = ["ts", "event_count", "game_session", "event_id", "row_id"]


@query(
    "dedup_first",
    over_log(f"SELECT installation_id, type, row_id, title FROM log QUALIFY row_number() OVER (PARTITION BY installation_id, type ORDER BY {ORDER_SQL}) = 1"),
)
def _(spark, sf):
    return earliest_per_key(event_log(spark, sf), ["installation_id", "type"], ORDER, ["row_id", "title"])


@query(
    "dedup_last",
    over_log(
        """SELECT installation_id, type, row_id, title FROM log QUALIFY row_number() OVER (PARTITION BY installation_id, type
             ORDER BY ts DESC, event_count DESC, game_session DESC, event_id DESC, row_id DESC) = 1"""
    ),
)
def _(spark, sf):
    return latest_per_key(event_log(spark, sf), ["installation_id", "type"], ORDER, ["row_id", "title"])


@query(
    "pivot_counts",
    over_log(
        """SELECT installation_id, nullif(count(*) FILTER (type = 'Game'), 0) AS game, nullif(count(*) FILTER (type = 'Clip'), 0) AS clip,
             nullif(count(*) FILTER (type = 'Assessment'), 0) AS assessment,
             nullif(count(*) FILTER (type = 'Activity'), 0) AS activity FROM log GROUP BY 1"""
    ),
)
def _(spark, sf):
    wide = pivot_wide(event_log(spark, sf), ["installation_id"], "type", list(TYPES), F.count(F.lit(1)))
    return wide.withColumnsRenamed({t: t.lower() for t in TYPES})


@query("value_share", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def _(spark, sf):
    return value_share(load(spark, sf, "events"), "event_type").select("event_type", "n", six("share"))


# ---- sorts and unions -------------------------------------------------------------


@query("sort_multi", over_log(f"SELECT installation_id, ts, event_count, row_id FROM log ORDER BY installation_id, {ORDER_SQL}"))
def _(spark, sf):
    return event_log(spark, sf).orderBy("installation_id", *ORDER).select("installation_id", "ts", "event_count", "row_id")


@query("union_all", over_log("SELECT row_id, type FROM log WHERE type <> 'Assessment' UNION ALL SELECT row_id, type FROM log WHERE event_code = 2000"))
def _(spark, sf):
    log = event_log(spark, sf).select("row_id", "type", "event_code")
    return log.where("type <> 'Assessment'").unionByName(log.where("event_code = 2000")).drop("event_code")


@query(
    "union_missing",
    """SELECT c_custkey AS party, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, sf):
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("party"), F.col("s_acctbal").alias("balance"))
    return customers.unionByName(suppliers, allowMissingColumns=True)
