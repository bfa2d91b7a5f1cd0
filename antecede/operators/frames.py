"""Whole-frame operators: filling, aligning, reporting, pivoting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_values(df: DataFrame, col: str) -> list:
    """Sorted distinct values, for use as an explicit pivot list: as many as the result is to have columns."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def pivot_wide(df: DataFrame, keys: Sequence[str], col: str, values: Sequence, agg: Column) -> DataFrame:
    """One row per key and one column per listed value, NULL where absent."""
    return df.groupBy(*keys).pivot(col, list(values)).agg(agg)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def fill_max(df: DataFrame, cols: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """NULLs become the column's largest value, of ``source`` when given.

    The maxima are one row, fetched by a scalar subquery when the plan runs.
    """
    base = df if source is None else source
    tops = base.agg(F.struct(*[F.max(c).alias(c) for c in cols]).alias("tops")).scalar()
    chosen = set(cols)
    return (
        df.withColumn("_tops", tops)
        .select(*[
            (F.coalesce(F.col(c), F.col(f"_tops.{c}")).alias(c) if c in chosen else F.col(c)) for c in df.columns
        ])
    )


def align_to(df: DataFrame, columns: Sequence[str], fill: Column | None = None) -> DataFrame:
    """Exactly ``columns``, in that order; the ones ``df`` lacks are constant."""
    have = set(df.columns)
    missing = F.lit(0.0) if fill is None else fill
    return df.select(*[(F.col(c) if c in have else missing.alias(c)) for c in columns])


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value; the total is a scalar subquery."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def session_last_rows(df: DataFrame) -> DataFrame:
    """Rows holding their session's largest event_count; ties are all kept.

    A rank filter lets Spark drop lower rows before the exchange, so a huge
    session sends only its candidates.
    """
    best = Window.partitionBy("game_session").orderBy(F.col("event_count").desc_nulls_last())
    return (
        df.where(F.col("event_count").isNotNull())
        .withColumn("_rank", F.rank().over(best))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
