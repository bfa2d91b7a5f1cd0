"""Tables sorted over many tasks, and what a task has to know of the tasks before it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PID = "part of the range"


def partitions_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def in_ranges(df: DataFrame, n: int, keys: list[Column], order: list[Column] | None = None) -> DataFrame:
    """``df`` in ``n`` ranges of ``keys``, each sorted by ``order`` (the keys, where it is not given).  Nulls come first.

    Spark samples the keys to cut the ranges, so ``df`` should be a stored table and the keys short.
    """
    first = lambda columns: [c.asc_nulls_first() for c in columns]
    return df.repartitionByRange(n, *first(keys)).sortWithinPartitions(*first(order or keys))


def totals_before(parts: DataFrame, pid: str, value: str) -> dict[int, int]:
    """For each part the sum of ``value`` over the parts before it.  One number for each part reaches the driver."""
    sums = sorted(parts.groupBy(pid).agg(F.sum(value)).collect())
    out, total = {}, 0
    for part, own in sums:
        out[part] = total
        total += own
    return out
