"""Scores of a classifier, each one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quadratic_kappa(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Agreement of two integer ratings, quadratically weighted; one row."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    missed = F.avg((y - p) * (y - p))
    by_chance = F.avg(y * y) + F.avg(p * p) - F.lit(2.0) * F.avg(y) * F.avg(p)
    return df.agg((F.lit(1.0) - F.try_divide(missed, by_chance)).alias("kappa"))


def log_loss(df: DataFrame, label: str, scores: str = "scores", least: float = 1e-15) -> DataFrame:
    """Mean multiclass log loss of class scores (an array, one per class); one row.

    Scores count as shares of their sum, kept ``least`` away from 0 and 1; a row without label or scores does not count.
    """
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    own = F.get(F.col(scores), F.col(label).cast("int")) / total
    return df.agg(F.avg(-F.ln(F.greatest(F.least(own, F.lit(1 - least)), F.lit(least)))).alias("log_loss"))
