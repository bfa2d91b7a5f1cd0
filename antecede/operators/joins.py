"""Joins whose probe side may have most of its rows under one key.

Spark splits such a key at run time if both sides of the join are plain shuffles.  Where it cannot, a caller that knows the
key's share of the rows says over how many tasks to spread it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str], ways: int | None = None
) -> DataFrame:
    """Join with every key of ``big`` split over ``ways`` tasks; without ``ways``, a plain join.

    To spread, ``small`` must have few rows per key; it is repeated once per way.  Rows of
    ``big`` pick their way by the hash of ``spread_by``.  Valid for the joins
    that never output an unmatched ``small`` row.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    if ways is None:
        return big.join(small, list(on), how)
    # Never NULL, and declared so: the join then adds no filter that would keep
    # Spark from sharing an exchange between both sides.
    way = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int"), F.lit(0))
    salted = big.withColumn("_way", way)
    repeated = small.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return salted.join(repeated, [*on, "_way"], how).drop("_way")


def keep_matching(df: DataFrame, keys_df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys_df``; each at most once.

    The keys may repeat: an aggregation between shuffle and join would keep Spark from splitting a hot key.
    """
    return df.join(keys_df.select(*on), list(on), "left_semi")


def without_match(df: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs nowhere in ``rows``."""
    return df.join(rows.select(*on), list(on), "left_anti")
