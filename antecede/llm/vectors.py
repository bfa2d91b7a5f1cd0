"""Vectors as bytes, shared by the two vector operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.session import materialize


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def numbered(table: DataFrame) -> DataFrame:
    """A stored table of row, vec_id, embedding (floats as they are, else doubles) and usable."""
    vector = F.col("embedding").cast("array<float>" if dict(table.dtypes).get("embedding") == "array<float>" else "array<double>")
    return materialize(table.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"),
        usable(vector).alias("usable"),
    ))


def matrix(column) -> list[np.ndarray]:
    """The vectors of an Arrow list column, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sample(rows: DataFrame, size: int, dim: int) -> np.ndarray:
    """At most ``size`` vectors of ``dim`` numbers, the same ones on every run over the same table."""
    drawn = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64(F.col("embedding").cast("array<double>")), F.xxhash64("row")).limit(size)
    found = drawn.select("embedding").collect()
    return np.array([r[0] for r in found], dtype=np.float64).reshape(len(found), dim)


def usual_dim(rows: DataFrame) -> int:
    """The most frequent number of components, 0 if there is no row."""
    found = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return found[0][0] if found else 0


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def blocks(base: DataFrame, asked: DataFrame, key: list[str], base_size: int, asked_size: int) -> DataFrame:
    """Both sides of a block join in pieces of bounded size: each piece of ``base`` meets each piece of ``asked`` of its key.

    The columns are those of both (the same), ``asked`` a flag, ``key``, ``x`` and ``y``.  The table of sizes has a row
    for each key; whether it is broadcast is left to Spark.
    """
    size = lambda d, n, k: d.groupBy(*key).agg(F.ceil(F.count("*") / n).cast("int").alias(k))
    sizes = materialize(size(base, base_size, "nx").join(size(asked, asked_size, "ny"), key))
    pieces = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = base.join(sizes, key).withColumn("x", own("nx")).withColumn("y", pieces("ny")).withColumn("asked", F.lit(False))
    right = asked.join(sizes, key).withColumn("y", own("ny")).withColumn("x", pieces("nx")).withColumn("asked", F.lit(True))
    return left.unionByName(right).drop("nx", "ny")
