"""Aggregates over the strictly earlier rows of each anchor, without pairs.

An anchor is a (key, instant).  The textbook form joins anchors to rows on the
key and filters ``row.ts < anchor.ts``: its cost is anchors x rows per key, so
one heavy key makes it quadratic.  Here nothing is paired:

1. Rows are summed per (key, slot, instant, label) before any shuffle.  Equal
   instants collapse, so a slot holds at most its distinct instants x labels.
2. Rows and anchors meet on (key, slot).  One descending window gives each row
   its segment: the first anchor instant strictly after it inside the slot.
   What it sums up to is stored: narrow rows, read by the two branches that follow.
3. What no anchor of its slot follows is sent on to the first anchor of a later
   slot; where that is, a window over slots tells, one row for each.  What is left
   per anchor instant and label is what came since the anchor before it.
4. Only these are pivoted: wide rows exist per anchor, never per log row.
5. An anchor's state is the running total of its slot's segments plus the total
   of all earlier slots.  The latter is a window over the slots of one span of
   ``FAN`` slots, and one over spans: a key's window has a row for each span.

Families of rows that feed different features share the same union, exchange
and pivot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import slugs
from antecede.operators.timeline import HOUR, SLOT, with_slot
from antecede.session import materialize

KEYS = ("installation_id", "world2")
FAN = 64  # slots in a span

# n: rows; c: rows with a value; s: sum of values; q: sum of squared values; max: largest value;
# any: rows of the key at any time, before or after the anchor.
STATS = ("n", "c", "s", "q", "max", "any")


@dataclass(frozen=True)
class Cell:
    """A group of output columns: one per label and statistic.

    ``label`` is computed from the family's ``by`` columns.  Without a label the
    whole family (or the rows where ``when`` holds) feeds one column per stat.
    """

    name: str
    stats: tuple[str, ...] = ("n",)
    label: Column | None = None
    labels: tuple[str, ...] = ()
    when: Column | None = None

    def columns(self) -> list[tuple[str, str, str]]:
        """(raw pivot key, stat, output column) of every column."""
        if self.label is None:
            return [(f"{self.name}_{s}", s, f"{self.name}_{s}") for s in self.stats]
        return [
            (f"{self.name}_{s}__{v}", s, f"{self.name}_{s}__{g}")
            for s in self.stats
            for v, g in zip(self.labels, slugs(self.labels))
        ]


@dataclass(frozen=True)
class Family:
    """Rows that contribute to anchors, and the cells they feed.

    ``rows`` has the keys, the timestamp, and the ``by`` columns.  ``dense`` says
    that many rows may share one instant and label, so summing them before the
    first shuffle pays.
    """

    name: str
    rows: DataFrame
    cells: tuple[Cell, ...]
    by: tuple[str, ...] = ()
    value: Column | None = None
    dense: bool = True


def _slotted(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Rows with key and time.

    The filter is spelled out so that joins further up add none of their own:
    branches that read the same exchange stay identical, and Spark runs it once.
    """
    return with_slot(df, ts, seconds).where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, ts, SLOT)))


def _contributions(family: Family, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    value = F.lit(None).cast("double") if family.value is None else family.value.cast("double")
    flat = _slotted(family.rows, keys, ts, seconds).select(
        *keys, SLOT, "_t", *[F.col(c).cast("string").alias(c) for c in family.by], value.alias("_v")
    )
    if family.dense:
        out = flat.groupBy(*keys, SLOT, "_t", *family.by).agg(
            F.count(F.lit(1)).cast("double").alias("_n"),
            F.count("_v").cast("double").alias("_c"),
            F.sum("_v").alias("_s"),
            F.sum(F.col("_v") * F.col("_v")).alias("_q"),
            F.max("_v").alias("_m"),
        )
    else:
        out = flat.select(
            *keys, SLOT, "_t", *family.by,
            F.lit(1.0).alias("_n"),
            F.when(F.col("_v").isNotNull(), 1.0).otherwise(0.0).alias("_c"),
            F.col("_v").alias("_s"),
            (F.col("_v") * F.col("_v")).alias("_q"),
            F.col("_v").alias("_m"),
        )
    return out.withColumn("_family", F.lit(family.name))


def _entries(family: Family) -> Column:
    """Array of (pivot key, addend, candidate maximum) for one summed segment."""
    source = {"n": "_n", "c": "_c", "s": "_s", "q": "_q", "max": "_m"}
    none = F.lit(None).cast("double")
    parts = []
    for cell in family.cells:
        for stat in sorted({"n" if s == "any" else s for s in cell.stats}):
            key = F.lit(f"{cell.name}_{stat}")
            if cell.label is not None:
                key = F.concat(key, F.lit("__"), cell.label.cast("string"))
            if cell.when is not None:
                key = F.when(cell.when, key)
            amount = F.col(source[stat])
            add, top = (none, amount) if stat == "max" else (amount, none)
            parts.append(F.struct(key.alias("k"), add.alias("a"), top.alias("m")))
    return F.array(*parts)


STATE = {"_n": "sum", "_c": "sum", "_s": "sum", "_q": "sum", "_m": "max"}


def _merged(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.expr(f"{how}({c}) AS {c}") for c, how in STATE.items()])


def _segments(anchors: DataFrame, families: Sequence[Family], keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Rows summed up to the first anchor instant after them, and the anchors.

    ``_seg`` is that instant.  Rows no anchor of their slot follows go on to the
    first anchor of a later slot.  Rows after their key's last anchor keep a NULL
    ``_seg`` in that anchor's slot: they matter for totals only.
    """
    by = list(dict.fromkeys(c for family in families for c in family.by))
    tape = _slotted(anchors, keys, ts, seconds).select(
        *keys, SLOT, "_t", F.struct(*anchors.columns).alias("_anchor")
    )
    for family in families:
        tape = tape.unionByName(_contributions(family, keys, ts, seconds), allowMissingColumns=True)

    # Descending order with a bound one microsecond behind: anchors strictly later.
    later = (
        Window.partitionBy(*keys, SLOT).orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    )
    own = F.when(F.col("_anchor").isNotNull(), F.col("_t"))
    cut = tape.withColumn("_seg", F.coalesce(own, F.min(own).over(later)))
    # The tape is sorted once: its sums are a table, and the branches read that.
    summed = materialize(_merged(cut, *keys, SLOT, "_seg", "_anchor", "_family", *by))
    settled = summed.where("_seg IS NOT NULL")
    tails = summed.where("_seg IS NULL")
    # One row per slot of a key, however many labels it has.
    slots = summed.groupBy(*keys, SLOT).agg(F.min(F.when(F.col("_anchor").isNotNull(), F.col("_seg"))).alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy(F.col(SLOT).desc()).rowsBetween(Window.unboundedPreceding, -1)
    target = slots.select(*keys, SLOT, F.min("_first").over(ahead).alias("_seg"), F.max("_first").over(Window.partitionBy(*keys)).alias("_final"))
    moved = (
        tails.drop("_seg").join(target.where("_final IS NOT NULL"), [*keys, SLOT])
        .withColumn(SLOT, F.expr(f"coalesce(_seg, _final) div {seconds * 1_000_000}"))
        .drop("_final")
    )
    together = settled.unionByName(moved, allowMissingColumns=True).repartition(*keys, SLOT)
    return _merged(together, *keys, SLOT, "_seg", "_anchor", "_family", *by)


def _earlier(per_slot: DataFrame, keys: Sequence[str], added: Sequence[str], topped: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """For each slot what all earlier slots of its key add up to (``_b_``), and the key's totals (``_all_``)."""
    key_list = ", ".join(f"`{k}`" for k in keys)
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    in_span = f"OVER (PARTITION BY {key_list}, _span ORDER BY {SLOT} {rows}"
    spans = f"OVER (PARTITION BY {key_list} ORDER BY _span {rows}"
    spanned = per_slot.withColumn("_span", F.expr(f"{SLOT} div {FAN}"))
    local = spanned.selectExpr(
        *keys, SLOT, "_span",
        *[f"sum(`{c}`) {in_span} AS `_l_{c}`" for c in added], *[f"max(`{c}`) {in_span} AS `_l_{c}`" for c in topped],
    )
    per_span = spanned.groupBy(*keys, "_span").agg(
        *[F.expr(f"sum(`{c}`) AS `{c}`") for c in added], *[F.expr(f"max(`{c}`) AS `{c}`") for c in topped]
    )
    carried = per_span.selectExpr(
        *keys, "_span",
        *[f"sum(`{c}`) {spans} AS `_s_{c}`" for c in added],
        *[f"max(`{c}`) {spans} AS `_s_{c}`" for c in topped],
        *[f"sum(`{c}`) OVER (PARTITION BY {key_list}) AS `_all_{c}`" for c in totals],
    )
    return local.join(carried, [*keys, "_span"]).selectExpr(
        *keys, SLOT,
        *[f"coalesce(`_l_{c}`, 0D) + coalesce(`_s_{c}`, 0D) AS `_b_{c}`" for c in added],
        *[f"greatest(`_l_{c}`, `_s_{c}`) AS `_b_{c}`" for c in topped],
        *[f"`_all_{c}`" for c in totals],
    )


def prior_table(
    anchors: DataFrame,
    families: Sequence[Family],
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
    slot_seconds: int = HOUR,
) -> DataFrame:
    """``anchors`` with one double column per cell, label and statistic.  Runs a job.

    Sums and counts are 0 and maxima NULL where nothing came before.  An anchor
    with a NULL key or time has no earlier rows by definition and is left out, and
    anchors equal in all columns are one.  Wide
    column lists are written as SQL texts: building hundreds of Column objects
    one call at a time costs more than the query at small sizes.
    """
    sums, tops, totals = [], [], []
    for cell in (cell for family in families for cell in family.cells):
        for raw, stat, out in cell.columns():
            if stat == "any":
                totals.append((raw.replace(f"{cell.name}_any", f"{cell.name}_n", 1), out))
            else:
                (tops if stat == "max" else sums).append((raw, out))
    added = list(dict.fromkeys(raw for raw, _ in [*sums, *totals]))
    topped = [raw for raw, _ in tops]

    segments = _segments(anchors, families, keys, ts, slot_seconds)
    entries = None
    for family in families:
        test = F.col("_family") == family.name
        entries = F.when(test, _entries(family)) if entries is None else entries.when(test, _entries(family))
    wide = (
        segments.select(*keys, SLOT, "_seg", "_anchor", F.explode_outer(entries).alias("_e"))
        .select(*keys, SLOT, "_seg", "_anchor", "_e.*")
        .where("k IS NOT NULL OR _anchor IS NOT NULL")
        .groupBy(*keys, SLOT, "_seg", "_anchor")
        .pivot("k", [*added, *topped])
        .agg(F.coalesce(F.sum("a"), F.max("m")))
    )

    key_list = ", ".join(f"`{k}`" for k in keys)
    # The range frame ends with the anchor's own instant, where its segment sits;
    # what came after the last anchor has no instant and sorts behind.
    in_slot = f"OVER (PARTITION BY {key_list}, {SLOT} ORDER BY _seg NULLS LAST RANGE UNBOUNDED PRECEDING)"
    here = wide.selectExpr(
        *keys, SLOT, "_anchor",
        *[f"sum(`{c}`) {in_slot} AS `{c}`" for c in added],
        *[f"max(`{c}`) {in_slot} AS `{c}`" for c in topped],
    ).where("_anchor IS NOT NULL")
    per_slot = wide.groupBy(*keys, SLOT).agg(
        *[F.expr(f"sum(`{c}`) AS `{c}`") for c in added], *[F.expr(f"max(`{c}`) AS `{c}`") for c in topped]
    )
    before = _earlier(per_slot, keys, added, topped, [raw for raw, _ in totals])
    return here.join(before, [*keys, SLOT]).selectExpr(
        "_anchor.*",
        *[f"coalesce(`{raw}`, 0D) + coalesce(`_b_{raw}`, 0D) AS `{out}`" for raw, out in sums],
        *[f"greatest(`{raw}`, `_b_{raw}`) AS `{out}`" for raw, out in tops],
        *[f"coalesce(`_all_{raw}`, 0D) AS `{out}`" for raw, out in totals],
    )
