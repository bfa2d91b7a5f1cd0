"""Order-dependent operators whose tasks stay small when one key is huge.

A window over ``partitionBy(user)`` puts a user's whole history into one task.
If one user owns a third of the log, that task is the job.  The operators here
window over ``(key, slot)`` instead, where the slot is any coarse, monotone
function of the sort order (an hour of the timestamp, a prefix of a hash).  What
crosses a slot border is carried by one summary row per (key, slot), and only
those summaries are ever windowed by key alone: their number is bounded by the
number of slots, not by the rows.

Keys and times may be NULL: a NULL is a value of its own, and no row is lost.  Joins and
windows use the key and slot as one struct, which compares NULLs as equal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import micros

SLOT = "_slot"
HOUR = 3600


def with_slot(df: DataFrame, ts: str = "ts", seconds: int = HOUR) -> DataFrame:
    """Adds the time slot of ``ts``; integer division keeps it monotone."""
    at = micros(df, ts)
    return df.withColumns({"_t": F.expr(at), SLOT: F.expr(f"({at}) div {seconds * 1_000_000}")})


AT = "_at"


def with_place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds key and slot as one struct, never NULL itself."""
    return df.withColumn(AT, F.struct(*keys, SLOT))


def join_slots(local: DataFrame, per_slot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what their slot carries; ``per_slot`` has one row for each key and slot."""
    return local.join(with_place(per_slot, keys).drop(*keys, SLOT), AT).drop(AT)


def _earlier_slots(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based position of each row inside its key.  ``df`` carries a slot."""
    local = with_place(df, keys).withColumn(name, F.row_number().over(Window.partitionBy(AT).orderBy(*order)).cast("bigint"))
    sizes = df.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        *keys, SLOT, F.coalesce(F.sum("_size").over(_earlier_slots(keys)), F.lit(0)).alias("_before")
    )
    return join_slots(local, before, keys).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], name: str = "prev"
) -> DataFrame:
    """Struct of the preceding row's ``cols``, NULL for a key's first row.

    ``order`` is ascending and must be total, so the result does not depend on
    how the input was partitioned.
    """
    row = F.struct(*cols)
    in_slot = Window.partitionBy(AT).orderBy(*order)
    # The same window tells a slot's last row: nothing follows it.
    local = with_place(df, keys).withColumns({name: F.lag(row).over(in_slot), "_next": F.lead(F.lit(True)).over(in_slot)})
    ends = local.where("_next IS NULL").select(*keys, SLOT, row.alias("_end"))
    carried = ends.select(
        *keys, SLOT, F.lag("_end").over(Window.partitionBy(*keys).orderBy(SLOT)).alias("_carried")
    )
    return (
        join_slots(local.drop("_next"), carried, keys)
        .withColumn(name, F.coalesce(F.col(name), F.col("_carried")))
        .drop("_carried")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Adds, per entry of ``sums`` (name: SQL text), its total up to and including the row."""
    names = ", ".join(keys)
    to_here = f"OVER (PARTITION BY {AT} ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING)"
    earlier = f"OVER (PARTITION BY {names} ORDER BY {SLOT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local = with_place(df, keys).selectExpr("*", *[f"sum({text}) {to_here} AS {name}" for name, text in sums.items()])
    per_slot = df.groupBy(*keys, SLOT).agg(*[F.expr(f"sum({text}) AS {name}") for name, text in sums.items()])
    before = per_slot.selectExpr(*keys, SLOT, *[f"sum({name}) {earlier} AS _b_{name}" for name in sums])
    return join_slots(local, before, keys).selectExpr(
        *df.columns, *[f"coalesce({name}, 0D) + coalesce(_b_{name}, 0D) AS {name}" for name in sums]
    )


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The first row of each key.  Spark keeps one row per key and task before the exchange."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    needed = [F.col(c) for c in dict.fromkeys([*keys, *cols])]
    return df.withColumn("_place", place).where("_place = 1").select(*needed)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _first(df, keys, [F.desc(c) for c in order], cols)


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _first(df, keys, [F.asc(c) for c in order], cols)


def asof_row(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str = "ts", ties: Sequence[str] = (),
    tolerance_seconds: float | None = None, strict: bool = True, slot_seconds: int = HOUR, name: str = "asof",
) -> DataFrame:
    """``left`` with ``name``: ``cols`` and time of the last row of ``right`` before it under the same keys, as a struct.

    Of rows at one instant the one with the largest ``ties`` counts.  ``strict`` leaves out rows at the left row's own instant.
    A row further back than the tolerance does not count.  NULL where there is none; NULL keys or times match nothing.
    Nothing is paired: both sides meet in windows over a key's slots, and each slot hands its last row on.
    """
    found = F.struct("_t", *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)], F.struct(F.col(ts), *cols).alias("_found"))
    usable = " AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, ts))
    asked = with_slot(left.withColumn("_left", F.struct(*left.columns)), ts, slot_seconds).select(*keys, SLOT, "_t", "_left")
    known = with_slot(right.where(usable), ts, slot_seconds).select(*keys, SLOT, "_t", found.alias("_right"))
    tape = with_place(asked.unionByName(known, allowMissingColumns=True), keys)
    upto = Window.partitionBy(AT).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    local = tape.withColumn("_last", F.max("_right").over(upto)).where("_left IS NOT NULL").drop("_right")
    # One row for each slot; the time comes first in the struct, so the largest one is the latest.
    per_slot = tape.groupBy(*keys, SLOT).agg(F.max("_right").alias("_slot_last"))
    before = per_slot.select(*keys, SLOT, F.max("_slot_last").over(_earlier_slots(keys)).alias("_before"))
    met = join_slots(local, before, keys).withColumn("_last", F.coalesce("_last", "_before"))
    near = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "_t"))) & F.col("_last").isNotNull()
    if tolerance_seconds is not None:
        near &= F.col("_t") - F.col("_last._t") <= round(tolerance_seconds * 1_000_000)
    return met.select("_left.*", F.when(near, F.col("_last._found")).alias(name))


def rule_at_or_above(
    df: DataFrame, rules: DataFrame, label: str, value: str, width: float, threshold: str = "threshold", score: str = "score",
    default: int = 0, name: str = "bucket",
) -> DataFrame:
    """``df`` with the score of its label's smallest threshold that is not below its value, or ``default`` beyond the last.

    ``rules`` has rows of label, threshold and score, any number for each label; of equal thresholds the smallest score
    counts.  Rows and rules meet in windows over a label and ``width`` of values, and each slot hands its first rule down,
    so a label with most rows is split.  Labels without rules, NULL values and NaN get ``default``.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(label).alias("_label"), v.alias("_v"))
    steps = rules.where(F.col(label).isNotNull() & F.col(threshold).isNotNull()).select(
        F.col(label).alias("_label"), F.col(threshold).cast("double").alias("_v"),
        F.struct(F.col(threshold).cast("double").alias("at"), F.col(score).alias("score")).alias("_rule"),
    )
    tape = rows.unionByName(steps, allowMissingColumns=True).withColumn(SLOT, F.floor(F.col("_v") / width))
    tape = with_place(tape, ["_label"])
    # Descending: a rule comes before the rows at its own threshold.
    down = Window.partitionBy(AT).orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = tape.withColumn("_next", F.min("_rule").over(down)).where("_row IS NOT NULL").drop("_rule")
    per_slot = tape.groupBy("_label", SLOT).agg(F.min("_rule").alias("_slot_first"))
    above = Window.partitionBy("_label").orderBy(F.col(SLOT).desc()).rowsBetween(Window.unboundedPreceding, -1)
    handed = per_slot.select("_label", SLOT, F.min("_slot_first").over(above).alias("_above"))
    met = join_slots(local, handed, ["_label"])
    fits = F.col("_v").isNotNull() & F.col("_label").isNotNull()
    hit = F.when(fits, F.coalesce("_next", "_above")["score"])
    return met.select("_row.*", F.coalesce(hit, F.lit(default)).cast("int").alias(name))
