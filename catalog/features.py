"""The features, eligibility and matrices over the adapted event log.

The oracles use the direct form: join every anchor to its earlier rows.
"""

from __future__ import annotations

from antecede.functions import slug
from antecede.plans import features as X
from antecede.plans.eligibility import anchors, eligible_test, eligible_train, last_assessment
from antecede.plans.matrix import LABEL, assemble, feature_columns, test_matrix, train_matrix
from antecede.session import materialize
from catalog.adapter import (
    CODES,
    LAST_SQL,
    ROLES,
    SUBMIT_SQL,
    TITLES,
    event_log,
    labelled,
    over_log,
    over_test,
    over_train,
)

QUERIES, ORACLES = {}, {}
SAME_KEY = "a.installation_id = r.installation_id AND a.world2 = r.world2"
CLIPS = tuple(ROLES.clip_rules)


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


def rounded(df, *plain: str):
    """Doubles to six places, so that both engines' last bits agree."""
    return df.selectExpr(*[
        f"round(`{c}`, 6) AS `{c}`" if t == "double" and c not in plain else f"`{c}`" for c, t in df.dtypes
    ])


def _pick(column: str, label: object, how: str = "sum", value: str = "n") -> str:
    return f"{how}({value}) FILTER (label = '{label}')"


# ---- X1, X2, X3 -------------------------------------------------------------------


def counts_sql(prefix: str, label: str, labels, where: str) -> str:
    """CTEs ``<prefix>`` (wide counts per anchor with prior rows)."""
    columns = ", ".join(
        f"coalesce({_pick('n', v)}, 0)::BIGINT AS {prefix}_cnt__{slug(v)}" for v in labels
    )
    return f"""{prefix}_long AS (
        SELECT a.installation_id, a.game_session, a.ts, a.title, {label} AS label, count(*) AS n
        FROM anchors a JOIN log r ON {SAME_KEY} AND a.ts > r.ts
        WHERE r.type <> 'Assessment' AND {where} GROUP BY ALL),
      {prefix} AS (SELECT installation_id, game_session, ts, title, {columns} FROM {prefix}_long GROUP BY ALL)"""


def running_sql(prefix: str, labels) -> str:
    frame = "OVER (PARTITION BY installation_id, title ORDER BY ts, game_session ROWS UNBOUNDED PRECEDING)"
    parts = []
    for g in map(slug, labels):
        parts.append(f"round(avg({prefix}_cnt__{g}) {frame}, 6) AS {prefix}_mean__{g}")
        parts.append(f"round(coalesce(stddev_samp({prefix}_cnt__{g}) {frame}, 0), 6) AS {prefix}_std__{g}")
    return f"{prefix}_run AS (SELECT game_session, {', '.join(parts)} FROM {prefix})"


X1_SQL = counts_sql("x1", "r.title", TITLES, "r.event_code = 2000")
X2_SQL = counts_sql("x2", "CAST(r.event_code AS VARCHAR)", CODES, "true")
X3_SQL = counts_sql("x3", "concat(r.title, '_', CAST(r.event_code AS VARCHAR))", ROLES.title_codes, "true")
DROP_KEYS = "EXCLUDE (installation_id, ts, title)"


@query("anchors", over_log("SELECT installation_id, world2, game_session, ts, title FROM anchors"))
def _(spark, sf):
    return anchors(event_log(spark, sf), ROLES)


@query("x1_count", over_log(f"SELECT * {DROP_KEYS} FROM x1", X1_SQL))
def _(spark, sf):
    return X.x1(event_log(spark, sf), ROLES)


@query("x1_running", over_log("SELECT * FROM x1_run", X1_SQL, running_sql("x1", TITLES)))
def _(spark, sf):
    return rounded(X.x1_running(event_log(spark, sf), ROLES))


@query("x2_count", over_log(f"SELECT * {DROP_KEYS} FROM x2", X2_SQL))
def _(spark, sf):
    return X.x2(event_log(spark, sf), ROLES)


@query("x2_running", over_log("SELECT * FROM x2_run", X2_SQL, running_sql("x2", CODES)))
def _(spark, sf):
    return rounded(X.x2_running(event_log(spark, sf), ROLES))


@query("x3_count", over_log(f"SELECT * {DROP_KEYS} FROM x3", X3_SQL))
def _(spark, sf):
    return X.x3(event_log(spark, sf), ROLES)


# ---- X4, X5 -----------------------------------------------------------------------


def _x4_sql() -> str:
    columns = []
    for t in TITLES:
        g = slug(t)
        columns.append(f"coalesce(max(event_count) FILTER (label = '{t}'), 0)::BIGINT AS x4_max__{g}")
        columns.append(f"round(coalesce(avg(event_count) FILTER (label = '{t}'), 0), 6) AS x4_mean__{g}")
        columns.append(f"round(coalesce(stddev_samp(event_count) FILTER (label = '{t}'), 0), 6) AS x4_std__{g}")
    return f"""final_rows AS (
        SELECT * FROM log WHERE type <> 'Assessment'
        QUALIFY rank() OVER (PARTITION BY game_session ORDER BY event_count DESC) = 1),
      x4_long AS (SELECT a.game_session, r.title AS label, r.event_count FROM anchors a
        JOIN final_rows r ON {SAME_KEY} AND a.ts > r.ts),
      x4 AS (SELECT game_session, {', '.join(columns)} FROM x4_long GROUP BY 1)"""


X4_SQL = _x4_sql()
X5_SQL = f"""tries AS (
    SELECT game_session, count(*) AS n,
      max(CASE WHEN regexp_extract(event_data, '"correct":([a-z]+)', 1, 'i') = 'true' THEN 1 ELSE 0 END) AS good
    FROM log WHERE {SUBMIT_SQL} GROUP BY 1),
  x5 AS (SELECT game_session, good::BIGINT AS correct, n AS try, good / n AS accuracy,
    CAST(CASE WHEN good / n = 1 THEN 3 WHEN good / n >= 0.5 THEN 2 WHEN good / n > 0 THEN 1 ELSE 0 END AS INT) AS accuracy_group
    FROM tries)"""


@query("x4_event_count", over_log("SELECT * FROM x4", X4_SQL))
def _(spark, sf):
    return rounded(X.x4(event_log(spark, sf), ROLES))


@query("x5_accuracy", over_log("SELECT game_session, correct, \"try\", round(accuracy, 6) AS accuracy, accuracy_group FROM x5", X5_SQL))
def _(spark, sf):
    return rounded(X.x5(event_log(spark, sf), ROLES))


# ---- X6 ---------------------------------------------------------------------------


NEXT_SQL = """followed AS (
    SELECT *, lag(type = 'Clip') OVER w AS after_clip, lag(ts) OVER w AS clip_ts,
      lag(title) OVER w AS clip_title, lag(game_session) OVER w AS clip_session, lag(world2) OVER w AS clip_world
    FROM log WINDOW w AS (PARTITION BY installation_id ORDER BY ts, event_count, game_session, event_id, row_id)),
  timed AS (SELECT *, date_diff('microsecond', clip_ts, ts) / 1e6 AS duration FROM followed WHERE after_clip)"""
IS_CLIP = "IN ({})".format(", ".join(f"'{t}'" for t in CLIPS))
SCORE = "CAST(CASE WHEN duration <= 7200 THEN 0 WHEN duration <= 86400 THEN 1 WHEN duration <= 259200 THEN 2 ELSE 0 END AS INT)"
CLIPS_SQL = f"""{NEXT_SQL},
  clips AS (SELECT installation_id, game_session, title, world2, ts, duration, {SCORE} AS score
            FROM timed WHERE title {IS_CLIP})"""
SELF_SQL = f"""{NEXT_SQL},
  clips AS (SELECT installation_id, clip_session AS game_session, clip_title AS title, clip_world AS world2,
              clip_ts AS ts, duration, {SCORE} AS score FROM timed WHERE clip_title {IS_CLIP})"""


def _x6_sql() -> str:
    columns = ", ".join(
        f"round(coalesce(avg(score) FILTER (label = '{t}' AND before), 0), 6) AS x6__{slug(t)}" for t in CLIPS
    )
    return f"""x6_long AS (
        SELECT a.game_session, r.title AS label, r.score, coalesce(a.ts > r.ts, false) AS before, r.ts IS NULL AS never
        FROM anchors a LEFT JOIN clips r ON {SAME_KEY}),
      x6 AS (SELECT game_session, {columns} FROM x6_long GROUP BY 1 HAVING bool_or(before) OR bool_or(never))"""


X6_SQL = _x6_sql()


@query("x6_clip_duration", over_log("SELECT installation_id, game_session, title, world2, ts, round(duration, 6) AS duration FROM clips", CLIPS_SQL))
def _(spark, sf):
    return rounded(X.x6_clips(event_log(spark, sf), ROLES).drop("score"))


@query("x6_clip_score", over_log("SELECT installation_id, ts, title, score FROM clips", CLIPS_SQL))
def _(spark, sf):
    return X.x6_clips(event_log(spark, sf), ROLES).select("installation_id", "ts", "title", "score")


@query("x6_clip_self", over_log("SELECT installation_id, game_session, title, world2, ts, round(duration, 6) AS duration, score FROM clips", SELF_SQL))
def _(spark, sf):
    return rounded(X.x6_clips(event_log(spark, sf), ROLES, attribute="self"))


@query("x6_clip_mean", over_log("SELECT * FROM x6", CLIPS_SQL, X6_SQL))
def _(spark, sf):
    return rounded(X.x6(event_log(spark, sf), ROLES))


# ---- X7, X8 -----------------------------------------------------------------------


def first_sql(prefix: str, names, rows: str = "true") -> str:
    """``rows`` restricts what a session's smallest count may look at."""
    ctes, columns, joins = [], [], []
    for i, (event, name) in enumerate(names.items()):
        part = f"{prefix}_{i}"
        ctes.append(f"""{part}_s AS (
            SELECT installation_id, world2, game_session, title, min(ts) AS ts, min(event_count) AS event_count
            FROM log WHERE event_id = '{event}' GROUP BY ALL),
          {part} AS (
            SELECT a.game_session, CASE WHEN count(r.ts) = 0 THEN 0 ELSE avg(r.event_count) FILTER (a.ts > r.ts) END AS v
            FROM anchors a LEFT JOIN {part}_s r ON {SAME_KEY} GROUP BY 1)""")
        columns.append(f"coalesce({part}.v, (SELECT max(v) FROM {part})) AS {prefix}__{slug(name)}")
        joins.append(f"LEFT JOIN {part} ON {part}.game_session = a.game_session")
    return ", ".join(ctes) + f", {prefix} AS (SELECT a.game_session, {', '.join(columns)} FROM anchors a {' '.join(joins)})"


def strict_sql(prefix: str, event: str, name: str) -> str:
    return f"""sessions AS (
        SELECT a.game_session, r.game_session AS s, r.title, min(r.event_count) FILTER (a.ts > r.ts) AS low
        FROM anchors a LEFT JOIN log r ON {SAME_KEY} AND r.event_id = '{event}' GROUP BY ALL),
      strict AS (SELECT game_session, CASE WHEN count(s) = 0 THEN 0 ELSE avg(low) END AS v FROM sessions GROUP BY 1),
      {prefix} AS (SELECT game_session, coalesce(v, (SELECT max(v) FROM strict)) AS {prefix}__{slug(name)} FROM strict)"""


X7_SQL = first_sql("x7", ROLES.first_game)
X8_SQL = first_sql("x8", ROLES.first_activity)


@query("x7_first_correct", over_log("SELECT game_session, round(x7__click_one, 6) AS x7__click_one FROM x7", X7_SQL))
def _(spark, sf):
    return rounded(X.x7(event_log(spark, sf), ROLES))


@query("x7_first_strict", over_log("SELECT game_session, round(x7__click_one, 6) AS x7__click_one FROM x7", strict_sql("x7", "click_1", "click one")))
def _(spark, sf):
    return rounded(X.x7(event_log(spark, sf), ROLES, strict=True))


@query("x8_first_correct", over_log("SELECT game_session, round(x8__signup_two, 6) AS x8__signup_two FROM x8", X8_SQL))
def _(spark, sf):
    return rounded(X.x8(event_log(spark, sf), ROLES))


# ---- X9 to X12 ----------------------------------------------------------------------


X9_SQL = """x9 AS (SELECT game_session, row_number() OVER (PARTITION BY installation_id, title
    ORDER BY ts, event_count, game_session, event_id, row_id) - 1 AS count
  FROM log WHERE type = 'Assessment' AND event_code = 2000)"""
X12_SQL = """x12 AS (SELECT game_session, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS dayofweek
  FROM log WHERE type = 'Assessment' AND event_count = 1)"""
DEALT_SQL = """starts AS (
    SELECT * FROM log WHERE type = 'Assessment' AND event_code = 2000),
  titles AS (SELECT title, row_number() OVER (ORDER BY first) AS place FROM
    (SELECT title, min((installation_id, ts, event_count, game_session, event_id, row_id)) AS first FROM starts GROUP BY 1)),
  listed AS (SELECT installation_id,
      row_number() OVER (PARTITION BY installation_id, title ORDER BY ts, row_id) - 1 AS number,
      row_number() OVER (PARTITION BY installation_id ORDER BY place, ts, row_id) AS k
    FROM starts JOIN titles USING (title)),
  placed AS (SELECT installation_id, game_session,
      row_number() OVER (PARTITION BY installation_id ORDER BY ts, event_count, game_session, event_id, row_id) AS k
    FROM starts)"""


@query("x9_attempt", over_log("SELECT game_session, count FROM x9", X9_SQL))
def _(spark, sf):
    return X.x9(event_log(spark, sf), ROLES)


@query("x9_by_position", over_log("SELECT game_session, number AS count FROM placed JOIN listed USING (installation_id, k)", DEALT_SQL))
def _(spark, sf):
    return X.x9(event_log(spark, sf), ROLES, by_position=True)


def help_sql(prefix: str, names, per_event: bool = False) -> str:
    ids = ", ".join(f"'{i}'" for i in names)
    columns = ", ".join(
        (f"count(*) FILTER (before AND event_id = '{i}')" if per_event else
         f"CASE WHEN count(*) FILTER (before AND event_id = '{i}') > 0 THEN count(*) FILTER (before) ELSE 0 END")
        + f" AS {prefix}__{slug(n)}"
        for i, n in names.items()
    )
    return f"""{prefix}_long AS (
        SELECT a.game_session, r.event_id, coalesce(a.ts > r.ts, false) AS before, r.ts IS NULL AS never
        FROM anchors a LEFT JOIN log r ON {SAME_KEY} AND r.event_id IN ({ids})),
      {prefix} AS (SELECT game_session, {columns} FROM {prefix}_long GROUP BY 1 HAVING bool_or(before) OR bool_or(never))"""


X10_SQL = help_sql("x10", ROLES.help_game)
X11_SQL = help_sql("x11", ROLES.help_activity)


@query("x10_help", over_log("SELECT * FROM x10", X10_SQL))
def _(spark, sf):
    return X.x10(event_log(spark, sf), ROLES)


@query("x10_help_per_event", over_log("SELECT * FROM x10", help_sql("x10", ROLES.help_game, per_event=True)))
def _(spark, sf):
    return X.x10(event_log(spark, sf), ROLES, per_event=True)


@query("x11_help", over_log("SELECT * FROM x11", X11_SQL))
def _(spark, sf):
    return X.x11(event_log(spark, sf), ROLES)


@query("x12_hour_dow", over_log("SELECT * FROM x12", X12_SQL))
def _(spark, sf):
    return X.x12(event_log(spark, sf), ROLES)


# ---- X13, X14 -----------------------------------------------------------------------


def _x13_sql() -> str:
    columns = ", ".join(
        f"round(coalesce(stddev_pop({a}) FILTER (label = '{t}'), 0), 6) AS x13_{a}__{slug(t)}"
        for a in ("x", "y") for t in TITLES
    )
    return f"""clicks AS (
        SELECT *, CAST(regexp_extract(event_data, '"x":([0-9]+)', 1) AS BIGINT) AS x,
          CAST(regexp_extract(event_data, '"y":([0-9]+)', 1) AS BIGINT) AS y
        FROM log WHERE type <> 'Assessment' AND regexp_matches(event_data, '("x":[0-9]+).+("y":[0-9]+)')),
      click_sessions AS (
        SELECT installation_id, world2, title, game_session, stddev_pop(x) AS x, stddev_pop(y) AS y, min(ts) AS ts
        FROM clicks GROUP BY ALL),
      x13_long AS (SELECT a.game_session, r.title AS label, r.x, r.y FROM anchors a
        JOIN click_sessions r ON {SAME_KEY} AND a.ts > r.ts),
      x13 AS (SELECT game_session, {columns} FROM x13_long GROUP BY 1)"""


X13_SQL = _x13_sql()
X14_SQL = f"""x14 AS (SELECT a.game_session, date_diff('microsecond', max(r.ts), max(a.ts)) / 1e6 AS seconds
  FROM anchors a JOIN log r ON {SAME_KEY} AND a.ts > r.ts WHERE r.type <> 'Assessment' GROUP BY 1)"""


@query("x13_click_spread", over_log("SELECT * FROM x13", X13_SQL))
def _(spark, sf):
    return rounded(X.x13(event_log(spark, sf), ROLES))


X13_STRICT_SQL = X13_SQL[: X13_SQL.index("click_sessions AS")] + f"""x13_long AS (
    SELECT a.game_session, r.title AS label, r.game_session AS s, stddev_pop(r.x) AS x, stddev_pop(r.y) AS y
    FROM anchors a JOIN clicks r ON {SAME_KEY} AND a.ts > r.ts GROUP BY ALL),
  """ + X13_SQL[X13_SQL.index("x13 AS (SELECT"):]


@query("x13_click_strict", over_log("SELECT * FROM x13", X13_STRICT_SQL))
def _(spark, sf):
    return rounded(X.x13(event_log(spark, sf), ROLES, strict=True))


@query("x14_gap", over_log("SELECT game_session, round(seconds, 6) AS seconds FROM x14", X14_SQL))
def _(spark, sf):
    return rounded(X.x14(event_log(spark, sf), ROLES))


# ---- eligibility and matrices ---------------------------------------------------------


@query("eligible_train", over_train("SELECT row_id, installation_id, world2 FROM log"))
def _(spark, sf):
    log = event_log(spark, sf)
    return eligible_train(log, labelled(log), ROLES).select("row_id", "installation_id", "world2")


@query("eligible_test", over_test("SELECT row_id, installation_id, world2 FROM log"))
def _(spark, sf):
    return eligible_test(event_log(spark, sf), ROLES).select("row_id", "installation_id", "world2")


@query("last_assessment", over_log("SELECT * FROM last_assessment", LAST_SQL))
def _(spark, sf):
    return last_assessment(event_log(spark, sf), ROLES)


@query(
    "assemble",
    over_log(
        """SELECT a.installation_id, a.game_session, coalesce(accuracy_group, 0) AS accuracy_group,
             coalesce("try", 0) AS tries, count AS attempt, hour
           FROM anchors a LEFT JOIN x5 USING (game_session) LEFT JOIN x9 USING (game_session) LEFT JOIN x12 USING (game_session)""",
        X5_SQL, X9_SQL, X12_SQL,
    ),
)
def _(spark, sf):
    log = event_log(spark, sf)
    base = anchors(log, ROLES).select("installation_id", "game_session")
    return assemble(base, [X.x5(log, ROLES), X.x9(log, ROLES), X.x12(log, ROLES)]).selectExpr(
        "installation_id", "game_session", "coalesce(accuracy_group, 0) AS accuracy_group",
        "coalesce(`try`, 0) AS tries", "count AS attempt", "hour",
    )


ALL_CTES = (
    X1_SQL, running_sql("x1", TITLES), X2_SQL, running_sql("x2", CODES), X3_SQL, X4_SQL, X5_SQL, CLIPS_SQL, X6_SQL,
    X7_SQL, X8_SQL, X9_SQL, X10_SQL, X11_SQL, X12_SQL, X13_SQL, X14_SQL,
)
TABLES = ("x1", "x1_run", "x2", "x2_run", "x3", "x4", "x5", "x6", "x7", "x8", "x9", "x10", "x11", "x12", "x13", "x14")


def matrix_select(extra: str = "", where: str = "true") -> str:
    """All features of every anchor; a helper table keeps only the last anchors."""
    columns = ", ".join(
        f"round(coalesce({c}, 0)::DOUBLE, 6) AS {c}" for c in feature_columns(ROLES)
    )
    joins = " ".join(f"LEFT JOIN {t} ON {t}.game_session = a.game_session" for t in TABLES)
    return f"SELECT a.installation_id, a.game_session, {columns}{extra} FROM anchors a {joins} WHERE {where}"


TRAIN_MATRIX_SQL = over_train(matrix_select(", coalesce(accuracy_group, 0) AS accuracy_group"), *ALL_CTES)
TEST_MATRIX_SQL = over_test(
    matrix_select(where="a.game_session IN (SELECT game_session FROM last_anchor)"),
    *ALL_CTES,
    """last_anchor AS (SELECT game_session FROM anchors
         QUALIFY row_number() OVER (PARTITION BY installation_id ORDER BY ts DESC, game_session DESC) = 1)""",
)


def training(spark, sf):
    log = event_log(spark, sf)
    return train_matrix(materialize(eligible_train(log, labelled(log), ROLES)), ROLES)


def testing(spark, sf, columns=None):
    return test_matrix(materialize(eligible_test(event_log(spark, sf), ROLES)), ROLES, columns)


@query("train_matrix", TRAIN_MATRIX_SQL)
def _(spark, sf):
    return rounded(training(spark, sf))


@query("test_matrix", TEST_MATRIX_SQL)
def _(spark, sf):
    return rounded(testing(spark, sf, ["installation_id", "game_session", *feature_columns(ROLES), LABEL]))
