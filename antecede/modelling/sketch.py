"""Quartiles of logs that are too large to count value by value: mergeable sketches, one for each day and column.

A day's rows are read once.  Its sketches are a few kilobytes for each column, stored by day; writing a day again replaces
it.  Quantiles of any set of days come from merging their sketches, without reading a row again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.modelling.prep import QUARTILES, long_values, spread_of

SIZE = 400


def rank_error(k: int = SIZE) -> float:
    """How far, as a share of the rows, a quantile's rank may be off in 99 of 100 sketches of size ``k``, merged ones included.

    The double-sided bound that the authors of the sketch give for it.
    """
    return 2.446 / k**0.9433


def sketches(df: DataFrame, cols: Sequence[str], day: Column, k: int = SIZE) -> DataFrame:
    """day, col, n, sketch: one row for each day and column.  NULL and NaN are no values; a NULL day is a day."""
    values = long_values(df.withColumn("day", day), cols, "day").where(~F.isnan("v"))
    return values.groupBy("day", "col").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def store_sketches(found: DataFrame, path: str) -> None:
    """Adds days to the folder ``path``; a day that is there already is replaced."""
    found.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_sketches(spark: SparkSession, path: str, day: str = "string") -> DataFrame:
    return spark.read.schema(f"col string, n long, sketch binary, day {day}").parquet(path)


def sketch_quantiles(found: DataFrame, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Rows of (col, prob, value) over all days of ``found``."""
    merged = found.groupBy("col").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    asked = F.array(*[F.lit(float(p)) for p in probs])
    told = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double("sketch", asked).alias("value"))
    return merged.select("col", F.inline(told).alias("prob", "value"))


def robust_fit_sketch(found: DataFrame) -> DataFrame:
    """Per column its median and interquartile range, as ``robust_fit`` gives them but within the sketches' rank error."""
    return spread_of(sketch_quantiles(found))


def rank_errors(df: DataFrame, answers: DataFrame) -> DataFrame:
    """col, prob, value, n, error: by how large a share of the rows each answer misses its rank.  One pass over ``df``.

    A value that repeats covers all ranks it holds; an answer inside them misses nothing.
    """
    rows = answers.collect()  # a row for each column and probability
    sums = []
    for i, r in enumerate(rows):
        v = F.col(r["col"]).cast("double")
        valid = v.isNotNull() & ~F.isnan(v)
        sums += [F.count_if(valid).alias(f"n{i}"), F.count_if(valid & (v < r["value"])).alias(f"l{i}"), F.count_if(valid & (v <= r["value"])).alias(f"u{i}")]
    told = F.explode(F.array(*[
        F.struct(
            F.lit(r["col"]).alias("col"), F.lit(r["prob"]).alias("prob"), F.lit(r["value"]).alias("value"), F.col(f"n{i}").alias("n"),
            F.greatest(F.col(f"l{i}") / F.col(f"n{i}") - r["prob"], r["prob"] - F.col(f"u{i}") / F.col(f"n{i}"), F.lit(0.0)).alias("error"),
        )
        for i, r in enumerate(rows)
    ])).alias("e")
    return df.agg(*sums).select(told).select("e.*")
