"""Exact quantiles, robust scaling and reproducible splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.operators.timeline import SLOT, numbered
from antecede.session import materialize

QUARTILES = (0.25, 0.5, 0.75)


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``features``, its columns of that list as one vector."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def long_values(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """A row for each value that is not NULL: col, v and the columns to keep."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols]))
    return df.select(*keep, cells.alias("e")).select(*keep, "e.*").where("v IS NOT NULL")


def _at_ranks(sizes: DataFrame, group: Sequence[str], own: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of counted values that lie in ranges: a row for each group and prob.

    ``sizes`` has a row for each group and range, ``own`` the values (v, n) of a group's range; only the ranges that hold a
    wanted rank are ordered.
    """
    before = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        sizes.withColumns({
            "below": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "total": F.sum("size").over(Window.partitionBy(*group)),
        })
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("at", F.col("prob") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("size")))
        # At most two ranges per group and probability.
        .select(*group, "piece", "prob", "at", "rank", "below").distinct()
    )
    upto = Window.partitionBy(*group, "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = own.join(wanted.select(*group, "piece"), [*group, "piece"], "left_semi")
    ordered = hit.withColumn("last", F.sum("n").over(upto))
    found = ordered.join(wanted, [*group, "piece"]).where(
        (F.col("below") + F.col("last") > F.col("rank")) & (F.col("below") + F.col("last") - F.col("n") <= F.col("rank"))
    )
    low, high = F.min("v"), F.max("v")
    part = F.max(F.col("at") - F.floor("at"))
    return found.groupBy(*group, "prob").agg((low + (high - low) * part).alias("value"))


def _in_pieces(counted: DataFrame) -> DataFrame:
    return materialize(counted.repartitionByRange("col", "v").withColumn("piece", F.spark_partition_id()))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact interpolated quantiles: rows of (col, prob, value).

    The built-in exact percentile keeps every distinct value of a group in one
    task's memory.  Here the counted values are dealt into ranges, as many as the
    session has shuffle partitions, and stored; only the ranges that hold a wanted
    rank are ordered.  Where the ranges end decides which task orders what, not the
    result.  Runs a job.
    """
    pieces = _in_pieces(long_values(df, cols).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n")))
    # One row for each column and range.
    sizes = pieces.groupBy("col", "piece").agg(F.sum("n").alias("size"))
    return _at_ranks(sizes, ["col"], pieces, probs)


def quantiles_without(
    df: DataFrame, cols: Sequence[str], fold: str, numbers: Sequence[int], probs: Sequence[float] = QUARTILES
) -> DataFrame:
    """Rows of (without, col, prob, value): quantiles of the rows outside each fold, all folds from one count of the values."""
    pieces = _in_pieces(long_values(df, cols, fold).groupBy("col", "v", fold).agg(F.count(F.lit(1)).alias("n")))
    other = pieces.withColumn("without", F.explode(F.array(*map(F.lit, numbers)))).where(F.col(fold) != F.col("without"))
    per_range = pieces.groupBy("col", "piece", fold).agg(F.sum("n").alias("size"))
    per_range = per_range.withColumn("without", F.explode(F.array(*map(F.lit, numbers)))).where(F.col(fold) != F.col("without"))
    sizes = per_range.groupBy("without", "col", "piece").agg(F.sum("size").alias("size"))
    values = other.groupBy("without", "col", "piece", "v").agg(F.sum("n").alias("n"))
    return _at_ranks(sizes, ["without", "col"], values, probs)


def spread_of(found: DataFrame, *group: str) -> DataFrame:
    """Median and interquartile range from quartiles (col, prob, value); a zero range counts as 1."""
    wide = found.groupBy(*group, "col").pivot("prob", list(QUARTILES)).agg(F.first("value"))
    spread = F.col("`0.75`") - F.col("`0.25`")
    return wide.select(
        *group, "col", F.col("`0.5`").alias("median"), F.when(spread == 0, 1.0).otherwise(spread).alias("iqr")
    )


def robust_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column its median and interquartile range; a zero range counts as 1."""
    return spread_of(quantiles(df, cols))


def robust_fit_without(df: DataFrame, cols: Sequence[str], fold: str, numbers: Sequence[int]) -> DataFrame:
    """``robust_fit`` of the rows outside each fold, with the fold as ``without``."""
    return spread_of(quantiles_without(df, cols, fold, numbers), "without")


def robust_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x - median) / iqr``.  The statistics arrive as one struct with a field per column, so a cell looks nothing up."""
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("median", "iqr")))).alias("by_name"))
    fields = F.struct(*[F.col("by_name")[c].alias(f"f{i}") for i, c in enumerate(cols)])
    place = {c: f"f{i}" for i, c in enumerate(cols)}
    # One row: the lookups by name are made once.
    staged = df.withColumn("_stats", packed.select(fields.alias("stats")).scalar())
    return staged.selectExpr(*[
        (f"(`{c}` - _stats.{place[c]}.median) / _stats.{place[c]}.iqr AS `{c}`" if c in place else f"`{c}`")
        for c in df.columns
    ])


def _digest(key: str, seed: int) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def holdout(df: DataFrame, key: str, frac: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds ``is_holdout``, by a hash of the key: the same row always lands the same."""
    bucket = F.conv(F.substring(_digest(key, seed), 1, 6), 16, 10).cast("bigint") % 10_000
    return df.withColumn("is_holdout", bucket < int(frac * 10_000))


def folds(df: DataFrame, label: str, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold``: within each label, rows are shuffled by hash and dealt out in turn.

    A label may own most rows, so positions are counted per hash prefix.  A NULL
    label is a label.
    """
    shuffled = df.withColumn("_digest", _digest(key, seed)).withColumn(SLOT, F.substring("_digest", 1, 3))
    placed = numbered(shuffled, [label], ["_digest", key], "_position")
    return placed.withColumn("fold", ((F.col("_position") - 1) % k).cast("int")).drop(
        "_position", "_digest", SLOT
    )
