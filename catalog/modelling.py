"""Scaling, splits, scores and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from antecede.modelling.boost import fit_boosted
from antecede.modelling.metrics import log_loss, quadratic_kappa
from antecede.modelling.model import average_scores, fit_classifier, out_of_fold, score, submission
from antecede.modelling.prep import folds, holdout, robust_apply, robust_fit
from antecede.modelling.sketch import rank_error, rank_errors, read_sketches, sketch_quantiles, sketches, store_sketches
from antecede.operators.frames import value_share
from antecede.plans import features as X
from antecede.plans.matrix import LABEL, feature_columns
from antecede.session import materialize, work_folder
from antecede.sources import load
from catalog.adapter import ROLES, event_log, over_log, over_train
from catalog.features import X5_SQL, testing, training

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SCALED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _scale_sql() -> str:
    stats = ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_r" for c in SCALED
    )
    cells = ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_r = 0 THEN 1 ELSE {c}_r END, 6) AS {c}" for c in SCALED)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cells} FROM lineitem, s"


@query("robust_scale", _scale_sql())
def _(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    scaled = robust_apply(lines, robust_fit(lines, SCALED), SCALED)
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in SCALED])


@query(
    "robust_scale_sketch",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, p AS prob, count({c}) AS n, true AS within FROM lineitem, (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(p) GROUP BY p"
        for c in SCALED
    ),
)
def _(spark, sf):
    """Quartiles from a sketch for each month, stored and merged: is each within the sketch's bound of its rank?"""
    lines = load(spark, sf, "lineitem")
    path = f"{work_folder(spark)}/sketches-{uuid.uuid4().hex}"
    store_sketches(sketches(lines, SCALED, F.date_format("l_shipdate", "yyyy-MM")), path)
    answers = sketch_quantiles(read_sketches(spark, path))
    return rank_errors(lines, answers).select("col", "prob", "n", (F.col("error") <= 1.5 * rank_error()).alias("within"))


@query(
    "split_holdout",
    over_log(
        """SELECT game_session, CAST('0x' || substr(md5('42|' || game_session), 1, 6) AS BIGINT) % 10000 < 2500 AS is_holdout FROM x5""",
        X5_SQL,
    ),
)
def _(spark, sf):
    return holdout(X.x5(event_log(spark, sf), ROLES).select("game_session"), "game_session")


@query(
    "stratified_folds",
    over_log(
        """SELECT game_session, accuracy_group, CAST((row_number() OVER (PARTITION BY accuracy_group
             ORDER BY md5('42|' || game_session), game_session) - 1) % 10 AS INT) AS fold FROM x5""",
        X5_SQL,
    ),
)
def _(spark, sf):
    return folds(X.x5(event_log(spark, sf), ROLES).select("game_session", LABEL), LABEL, "game_session")


GUESS = "CASE \"try\" WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END"


@query(
    "quadratic_kappa",
    over_log(
        """SELECT round(1 - (sum(n * (y - p) * (y - p)) / sum(n)) / (sum(n * y * y) / sum(n) + sum(n * p * p) / sum(n)
             - 2 * (sum(n * y) / sum(n)) * (sum(n * p) / sum(n))), 6) AS kappa FROM confusion""",
        X5_SQL,
        f"confusion AS (SELECT accuracy_group AS y, {GUESS} AS p, count(*) AS n FROM x5 GROUP BY ALL)",
    ),
)
def _(spark, sf):
    guess = F.expr(GUESS.replace('"', "`"))
    rated = X.x5(event_log(spark, sf), ROLES).withColumn("guess", guess)
    return quadratic_kappa(rated, LABEL, "guess").select(F.round("kappa", 6).alias("kappa"))


@query("class_share", over_log("SELECT accuracy_group, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM x5 GROUP BY 1", X5_SQL))
def _(spark, sf):
    return value_share(X.x5(event_log(spark, sf), ROLES), LABEL).select(LABEL, "n", F.round("share", 6).alias("share"))


@query(
    "fold_average",
    """SELECT l_orderkey, round(avg(l_discount), 6) AS p0, round(avg(l_tax), 6) AS p1, round(avg(l_quantity), 6) AS p2
       FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_discount", "l_tax", "l_quantity").alias("scores")
    )
    frames = [lines.where("l_linenumber % 2 = 0"), lines.where("l_linenumber % 2 = 1")]
    return average_scores(frames, "l_orderkey").select(
        "l_orderkey", *[F.round(F.col("scores")[i], 6).alias(f"p{i}") for i in range(3)]
    )


@query(
    "submission",
    over_log(
        """SELECT u.installation_id, CAST(coalesce(b.class, 0) AS INT) AS accuracy_group
           FROM (SELECT DISTINCT installation_id FROM log) u LEFT JOIN b USING (installation_id)""",
        X5_SQL,
        """b AS (SELECT installation_id, list_position(s, list_max(s)) - 1 AS class FROM
             (SELECT installation_id, [count(*) FILTER (accuracy_group = 0), count(*) FILTER (accuracy_group = 1),
                count(*) FILTER (accuracy_group = 2), count(*) FILTER (accuracy_group = 3)] AS s
              FROM anchors JOIN x5 USING (game_session) GROUP BY 1))""",
    ),
)
def _(spark, sf):
    """Each user's most frequent past group, as class scores, for every user of the log."""
    log = event_log(spark, sf)
    past = log.where(ROLES.is_anchor()).select("installation_id", "game_session").join(
        X.x5(log, ROLES).select("game_session", LABEL), "game_session"
    )
    votes = past.groupBy("installation_id").agg(
        F.array(*[F.count(F.when(F.col(LABEL) == g, 1)) for g in range(4)]).alias("scores")
    )
    return submission(votes, log.select("installation_id").distinct(), default=0)


LOSS_CLASS = "CAST(l_linenumber % 3 AS INT)"


@query(
    "log_loss",
    f"""WITH s AS (SELECT {LOSS_CLASS} AS y, [l_discount, l_tax, l_quantity / 50] AS p FROM lineitem)
        SELECT round(avg(-ln(greatest(least(p[y + 1] / list_sum(p), 1 - 1e-15), 1e-15))), 6) AS log_loss FROM s""",
)
def _(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.expr(LOSS_CLASS).alias("y"), F.array("l_discount", "l_tax", F.col("l_quantity") / 50).alias("scores")
    )
    return log_loss(rows, "y").select(F.round("log_loss", 6).alias("log_loss"))


BOOST = {"rounds": 12, "patience": 3, "rate": 0.6}
#: A class that the quantity tells in part, with a seventh of the lines at random.
SIZE_CLASS = (
    "CASE WHEN l_linenumber = 7 THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END "
    "WHEN l_quantity + 300 * l_discount < 25 THEN 0 WHEN l_quantity + 300 * l_discount < 45 THEN 1 ELSE 2 END"
)
TENS = "floor(l_quantity / 10)"


def _boost_sql() -> str:
    """A tree deep enough for every value of its one feature is a mean for each value, which SQL can follow round by round."""
    k = range(3)
    top = "greatest(f0, f1, f2)"
    share = ", ".join(f"exp(f{i} - {top}) / (exp(f0 - {top}) + exp(f1 - {top}) + exp(f2 - {top})) AS p{i}" for i in k)
    step = ", ".join(f"f{i} + {BOOST['rate']}::DOUBLE * ((n{i} - n * p{i}) / (n * greatest(p{i} * (1 - p{i}), 1e-6))) AS f{i}" for i in k)
    return f"""
WITH RECURSIVE lines AS (SELECT {SIZE_CLASS} AS y, {TENS} AS v, l_orderkey % 4 = 0 AS valid FROM lineitem),
cells AS (SELECT v, valid, {', '.join(f'count(*) FILTER (y = {i})::DOUBLE AS n{i}' for i in k)}, count(*)::DOUBLE AS n FROM lines GROUP BY ALL),
prior AS (SELECT {', '.join(f'ln(sum(n{i}) / sum(n)) AS f{i}' for i in k)} FROM cells WHERE NOT valid),
state AS (
  SELECT 0 AS m, v, f0, f1, f2 FROM (SELECT v FROM cells WHERE NOT valid), prior
  UNION ALL
  SELECT m + 1, v, {step} FROM (SELECT m, state.v, f0, f1, f2, n0, n1, n2, n, {share} FROM state JOIN cells ON cells.v = state.v AND NOT valid)
  WHERE m < {BOOST['rounds']}),
losses AS (
  SELECT m, valid, -sum({' + '.join(f'n{i} * ln(greatest(p{i}, 1e-15))' for i in k)}) / sum(n) AS loss
  FROM (SELECT m, valid, n0, n1, n2, n, {share} FROM state JOIN cells USING (v)) WHERE m > 0 GROUP BY ALL),
rounds AS (SELECT m, max(loss) FILTER (NOT valid) AS train_loss, max(loss) FILTER (valid) AS valid_loss FROM losses GROUP BY m),
judged AS (SELECT *, valid_loss < coalesce(min(valid_loss) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS better FROM rounds),
lasting AS (SELECT *, max(CASE WHEN better THEN m END) OVER (ORDER BY m) AS best FROM judged),
stop AS (SELECT coalesce(min(m) FILTER (m - best >= {BOOST['patience']}), max(m)) AS last FROM lasting)
SELECT m::INT AS round, round(train_loss, 6) AS train_loss, round(valid_loss, 6) AS valid_loss,
  m <= (SELECT best FROM lasting, stop WHERE m = last) AS kept FROM lasting, stop WHERE m <= last"""


@query("boost_rounds", _boost_sql())
def _(spark, sf):
    """Losses of every round of boosting on one feature, up to the stop."""
    lines = load(spark, sf, "lineitem").select(F.expr(SIZE_CLASS).alias("class"), F.expr(TENS).alias("tens"), "l_orderkey")
    model = fit_boosted(
        lines, ["tens"], "class", 3, F.col("l_orderkey") % 4 == 0, **BOOST, params={"maxDepth": 6, "maxBins": 32}
    )
    rows = [(r.round, r.train_loss, r.valid_loss, r.round <= model.best) for r in model.rounds]
    return spark.createDataFrame(rows, "round int, train_loss double, valid_loss double, kept boolean").select(
        "round", *[F.round(c, 6).alias(c) for c in ("train_loss", "valid_loss")], "kept"
    )


# ---- models: no SQL equivalent ------------------------------------------------------


def _trained(spark, sf):
    train = materialize(training(spark, sf))
    features = feature_columns(ROLES)
    return train, features


@query("fit_score")
def _(spark, sf):
    """Forest fitted on three quarters of the sessions, scoring the rest."""
    train, features = _trained(spark, sf)
    parts = holdout(train, "game_session")
    stats = materialize(robust_fit(train, features))
    scaled = robust_apply(parts, stats, features)
    model = fit_classifier(scaled.where("NOT is_holdout"), features, LABEL)
    return score(model, scaled.where("is_holdout"), features).select("game_session", LABEL, "scores", "predicted")


@query("holdout_scores")
def _(spark, sf):
    """Kappa and log loss of that forest on the held-out sessions."""
    train, features = _trained(spark, sf)
    parts = holdout(train, "game_session")
    model = fit_classifier(parts.where("NOT is_holdout"), features, LABEL)
    scored = materialize(score(model, parts.where("is_holdout"), features).select(LABEL, "scores", "predicted"))
    return quadratic_kappa(scored, LABEL, "predicted").withColumn("log_loss", log_loss(scored, LABEL).scalar())


def _held_out(spark, sf):
    """Ten folds; every training session is scored by the model that did not see it."""
    train, features = _trained(spark, sf)
    placed = materialize(folds(train, LABEL, "game_session"))
    held_out, _unused = out_of_fold(placed, features, LABEL, "game_session")
    return held_out


@query("out_of_fold")
def _(spark, sf):
    return _held_out(spark, sf).select("game_session", LABEL, "fold", "scores", "predicted")


@query("oof_kappa")
def _(spark, sf):
    """Kappa and log loss over all folds, and the share of sessions given each class."""
    scored = materialize(_held_out(spark, sf).select(LABEL, "scores", "predicted"))
    return value_share(scored, "predicted").withColumns({
        "kappa": quadratic_kappa(scored, LABEL, "predicted").scalar(), "log_loss": log_loss(scored, LABEL).scalar(),
    })


@query("fold_cover", over_train(
    """SELECT game_session, 1::BIGINT AS times, 1.0::DOUBLE AS total FROM anchors GROUP BY 1"""
))
def _(spark, sf):
    """Each training session is scored once, and its class scores add up to one."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return _held_out(spark, sf).groupBy("game_session").agg(
        F.count(F.lit(1)).alias("times"), F.round(F.max(total), 6).alias("total")
    )


@query("predict_test")
def _(spark, sf):
    """The whole path: ten folds of the training matrix score the test matrix, one class per user."""
    train, features = _trained(spark, sf)
    test = materialize(testing(spark, sf, ["installation_id", "game_session", *features]))
    placed = materialize(folds(train, LABEL, "game_session"))
    _unused, averaged = out_of_fold(
        placed, features, LABEL, "game_session", to_score=test.withColumn("game_session", F.col("installation_id").cast("string")),
    )
    scores = averaged.withColumnRenamed("game_session", "installation_id")
    return submission(scores, test.select(F.col("installation_id").cast("string").alias("installation_id")))
