"""Training and scoring with Spark ML."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import argmax
from antecede.modelling.boost import fit_boosted, score_boosted
from antecede.modelling.prep import robust_apply, robust_fit_without, vectors
from antecede.session import materialize

DEFAULTS = {"numTrees": 20, "maxDepth": 10, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7", "seed": 50}

Scorer = Callable[[DataFrame], DataFrame]
Learner = Callable[[DataFrame, Column, Sequence[str], str, Mapping[str, object] | None], Scorer]


def fit_classifier(
    df: DataFrame, features: Sequence[str], label: str, params: Mapping[str, object] | None = None
) -> Model:
    """A seeded random forest: the distributed multiclass learner with probabilities."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", **{**DEFAULTS, **(params or {})})
    return forest.fit(vectors(df.withColumn(label, F.col(label).cast("double")), features))


def score(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``scores``, the class probabilities, and ``predicted``, the best class."""
    out = model.transform(vectors(df, features))
    return out.withColumn("scores", vector_to_array("probability")).withColumn("predicted", argmax(F.col("scores")))


def average_scores(frames: Sequence[DataFrame], key: str, scores: str = "scores") -> DataFrame:
    """Mean of several models' class scores per key, class by class."""
    every = frames[0].select(key, scores)
    for frame in frames[1:]:
        every = every.unionByName(frame.select(key, scores))
    per_class = every.select(key, F.posexplode(scores).alias("class", "p")).groupBy(key, "class").agg(F.avg("p").alias("p"))
    # As long as there are classes.
    return per_class.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("class", "p"))), lambda e: e["p"]).alias(scores)
    )


def forest_learner(df: DataFrame, valid: Column, features: Sequence[str], label: str, params: Mapping[str, object] | None) -> Scorer:
    """A forest on the rows where ``valid`` does not hold."""
    model = fit_classifier(df.where(~valid), features, label, params)
    return lambda rows: score(model, rows, features)


def boosted_learner(classes: int, rounds: int = 100, patience: int = 10, rate: float = 0.1) -> Learner:
    """Boosting that stops by the loss of the rows where ``valid`` holds."""

    def learn(df: DataFrame, valid: Column, features: Sequence[str], label: str, params: Mapping[str, object] | None) -> Scorer:
        model = fit_boosted(df, features, label, classes, valid, rounds, patience, rate, params)
        return lambda rows: score_boosted(model, rows, features)

    return learn


def out_of_fold(
    df: DataFrame, features: Sequence[str], label: str, key: str, fold: str = "fold",
    to_score: DataFrame | None = None, params: Mapping[str, object] | None = None, learner: Learner = forest_learner, at_once: int = 4,
) -> tuple[DataFrame, DataFrame | None]:
    """Scores every row by the model that did not see its fold.

    Each fold has its own scaler, of its training part; those of all folds come from one count of the values.  ``df`` should
    be a table: a fold scales it once, as a table of vectors that its model reads.  At most ``at_once`` folds are fitted at
    the same time.  Also returns the average of the folds' scores of ``to_score``, scaled alike, if given.
    """
    spark = df.sparkSession
    numbers = sorted(r[0] for r in df.select(fold).distinct().collect())  # one row for each fold
    stats = materialize(robust_fit_without(df, features, fold, numbers))

    def one(number: int) -> tuple[DataFrame, DataFrame | None]:
        own = stats.where(F.col("without") == number).drop("without")
        scaled = materialize(robust_apply(df, own, features))
        scorer = learner(scaled, F.col(fold) == number, features, label, params)
        part = scorer(scaled.where(F.col(fold) == number)).select(key, label, fold, "scores", "predicted")
        foreign = None if to_score is None else scorer(robust_apply(to_score, own, features)).select(key, "scores")
        return part, foreign

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(one), numbers))
    held_out = functools.reduce(DataFrame.unionByName, [part for part, _ in parts])
    return held_out, average_scores([f for _, f in parts], key) if to_score is not None else None


def submission(
    scores: DataFrame, template: DataFrame, key: str = "installation_id", default: int | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """The template's users with their best class, matched by user, not by position.

    A user without scores gets ``default``: NULL, unless the caller names a class.  ``carry``: columns of the template
    that come along, its order for instance.
    """
    best = scores.select(key, argmax(F.col("scores")).alias("accuracy_group"))
    return template.select(key, *carry).join(best, key, "left").select(
        key, F.coalesce("accuracy_group", F.lit(default)).cast("int").alias("accuracy_group"), *carry
    )
