"""Multiclass boosting with early stopping.

Stagewise: every round fits one regression tree for each class to the residuals of the class softmax, all classes at once,
and adds the trees' answers to the scores of every row.  A tree's target is residual / curvature under the curvature as
weight, so each leaf takes a Newton step.  Scores and losses of training and validation rows live in a table that each
round rewrites; two numbers a round reach the driver.  It stops when the validation loss has not fallen for ``patience``
rounds, and keeps the trees up to the best round.

Rows equal in all features, in their label and in being held out have the same score in every round, so one row stands for
them, with their number as weight.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.functions import argmax
from antecede.modelling.prep import vectors
from antecede.session import discard, stored

TREE = {"maxDepth": 5, "maxBins": 64, "minInstancesPerNode": 1, "seed": 50}
LEAST_CURVATURE = 1e-6
LEAST_SHARE = 1e-15


@dataclass(frozen=True)
class Round:
    """Losses after a round; ``valid_loss`` is None without validation rows."""

    round: int
    train_loss: float
    valid_loss: float | None


@dataclass(frozen=True)
class Boosted:
    """``ensembles``: for each class the trees of all kept rounds, each weighted by the learning rate."""

    prior: tuple[float, ...]
    ensembles: tuple[GBTRegressionModel, ...]
    rounds: tuple[Round, ...]
    best: int


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def _loss(label: str) -> Column:
    own = -F.ln(F.greatest(F.get(_softmax(F.col("_scores")), F.col(label)), F.lit(LEAST_SHARE)))
    return F.sum(F.col("_rows") * own) / F.sum("_rows")


def _tree(state: DataFrame, label: str, k: int, params: Mapping[str, object]) -> DecisionTreeRegressionModel:
    p = F.get("_p", F.lit(k))
    curvature = F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))
    rows = state.where("NOT _valid").withColumn("_p", _softmax(F.col("_scores"))).select(
        "features", (F.col("_rows") * curvature).alias("_weight"), (((F.col(label) == k).cast("double") - p) / curvature).alias("_target")
    )
    return DecisionTreeRegressor(labelCol="_target", featuresCol="features", weightCol="_weight", **params).fit(rows)


def _with_trees(state: DataFrame, trees: Sequence[DecisionTreeRegressionModel], rate: float) -> DataFrame:
    out = state
    for k, tree in enumerate(trees):
        out = tree.setPredictionCol(f"_t{k}").transform(out)
    moved = F.array(*[F.get("_scores", F.lit(k)) + F.lit(rate) * F.col(f"_t{k}") for k in range(len(trees))])
    return out.withColumn("_scores", moved).select(*state.columns)


def _ensemble(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], rate: float) -> GBTRegressionModel:
    """The trees of one class as one model: one expression in a plan, however many rounds there were."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    members = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        members[i], weights[i] = tree._java_obj, float(rate)
    name = trees[0].uid.replace("DecisionTreeRegressor", "boost")
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(name, members, weights))


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, classes: int, valid: Column, rounds: int = 100, patience: int = 10,
    rate: float = 0.1, params: Mapping[str, object] | None = None,
) -> Boosted:
    """Trees on the rows of ``df`` where ``valid`` does not hold, judged by the rows where it does.

    ``label`` holds 0 to ``classes`` - 1; a row with another label, or none, is left out.  A class without a training row
    starts at the share of half a row.  Without training rows there is nothing to fit, which raises ValueError; without
    validation rows all ``rounds`` are made and kept.
    """
    spark = df.sparkSession
    params = {**TREE, **(params or {})}
    known = df.withColumn(label, F.col(label).cast("int")).where(F.col(label).between(0, classes - 1))
    known = known.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    if params["minInstancesPerNode"] == 1:
        known = known.groupBy(*dict.fromkeys([*features, label, "_valid"])).agg(F.count(F.lit(1)).alias("_rows"))
    else:  # a leaf's instances are rows, not different rows
        known = known.withColumn("_rows", F.lit(1))
    rows, rows_path = stored(vectors(known, features).select("features", label, "_valid", "_rows"))
    found = rows.where("NOT _valid").groupBy(label).agg(F.sum("_rows")).collect()  # a row for each class
    counts = {r[0]: r[1] for r in found}
    if not counts:
        raise ValueError("no training rows")
    total = sum(counts.values())
    shares = [max(counts.get(k, 0), 0.5) / total for k in range(classes)]
    prior = tuple(spark.range(1).select(F.array(*[F.ln(F.lit(s)) for s in shares])).first()[0])
    state, path = stored(rows.withColumn("_scores", F.array(*map(F.lit, prior))))
    discard(spark, rows_path)
    history: list[Round] = []
    grown: list[list[DecisionTreeRegressionModel]] = []
    best, lowest = 0, float("inf")
    with ThreadPoolExecutor(classes) as pool:
        for number in range(1, rounds + 1):
            fit = inheritable_thread_target(spark)(lambda k, state=state: _tree(state, label, k, params))
            trees = list(pool.map(fit, range(classes)))
            after, new_path = stored(_with_trees(state, trees, rate))
            discard(spark, path)
            state, path = after, new_path
            loss = {r[0]: r[1] for r in state.groupBy("_valid").agg(_loss(label)).collect()}
            history.append(Round(number, loss[False], loss.get(True)))
            grown.append(trees)
            judged = loss.get(True)
            if judged is None or judged < lowest:
                best, lowest = number, judged if judged is not None else lowest
            elif number - best >= patience:
                break
    discard(spark, path)
    ensembles = tuple(_ensemble(spark, [trees[k] for trees in grown[:best]], rate) for k in range(classes))
    return Boosted(prior, ensembles, tuple(history), best)


def score_boosted(model: Boosted, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``scores``, the class probabilities, and ``predicted``, the best class."""
    out = vectors(df, features)
    for k, ensemble in enumerate(model.ensembles):
        out = ensemble.setPredictionCol(f"_t{k}").transform(out)
    raw = F.array(*[F.lit(p) + F.col(f"_t{k}") for k, p in enumerate(model.prior)])
    return out.withColumn("scores", _softmax(raw)).withColumn("predicted", argmax(F.col("scores"))).drop(
        *[f"_t{k}" for k in range(len(model.prior))]
    )
