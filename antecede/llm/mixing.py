"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each document has a fixed 64-bit hash.  A source takes whole copies of all its documents and, for the rest of its
target, the documents whose hash lies below a threshold.  The threshold is found by histograms: words by source and
upper hash bits, then, of the one bucket in which the budget ends, by the next bits, and so on.  What the first document
that does not fit would leave open is filled by small documents, under a second threshold found in the same way.  All steps are
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.rows import whole_row
from antecede.session import materialize

DIGITS = 5  # of a hash, of BITS bits each: 60 bits decide
BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``weight`` by the rank of the source in code point order, null last, the weights repeating.

    Ranges of sources are numbered apart and shifted by what lies before them: no task sees all sources.
    """
    ordered = materialize(
        sources.orderBy(F.asc_nulls_last("source")).withColumn("place", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("place", 33))
    before, shift = 0, F.lit(0)
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):  # one row for each partition
        shift = F.when(F.col("part") == part, F.lit(before - (part << 33))).otherwise(shift)
        before += n
    rank = F.pmod(F.col("place") + shift, F.lit(len(weights)))
    return ordered.select("source", "source_size", F.array(*map(F.lit, weights))[rank.cast("int")].alias("weight"))


def with_targets(sources: DataFrame, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``target``: ``share`` of all words by weight, at most ``most`` times a source's words, the excess dealt again.

    A round needs two sums over the sources that are not full; the level they rise to only grows, so rounds end when no
    further source fills up.
    """
    cap = F.col("source_size") * F.lit(most)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        is_full = cap <= F.col("weight") * F.lit(level)
        n, capped, open_weight = sources.agg(
            F.sum(is_full.cast("long")), F.sum(F.when(is_full, cap)), F.sum(F.when(~is_full, F.col("weight")))
        ).first()
        if n in (None, full) or not open_weight:
            break
        full, level = n, max(level, (total - (capped or 0.0)) / open_weight)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if full >= 0 else F.lit(0.0))


def digit(level: int) -> Column:
    """Bits of the hash, from the highest."""
    return F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def threshold(sized: DataFrame, wants: DataFrame, nearer: bool) -> DataFrame:
    """source, upto and left: the longest run of hash prefixes whose words fit each source's budget, and what it leaves.

    ``wants``: source, budget, after, most_size; only documents of prefixes beyond ``after`` and of at most ``most_size``
    words count.  With ``nearer`` the next prefix is taken too if that brings the words nearer to the budget.
    """
    state = wants.withColumn("prefix", F.lit(0).cast("long")).withColumn("words", F.lit(None).cast("long"))
    key = Window.partitionBy("source")
    for level in range(DIGITS):
        above = F.shiftrightunsigned("hash", 64 - BITS * level) if level else F.lit(0).cast("long")
        counts = sized.select("source", "size", "hash", digit(level).alias("digit")).alias("d").join(
            state.alias("s"),
            F.col("d.source").eqNullSafe(F.col("s.source")) & (above == F.col("prefix")) & (F.col("size") <= F.col("most_size"))
            & (prefix() > F.col("after")),
        ).groupBy("s.source", "budget", "digit").agg(F.sum("size").alias("words"))
        running = F.sum("words").over(key.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        steps = counts.withColumn("to", running)
        # The bucket in which the budget ends; if it ends in none, the one after the last.
        over = F.when(F.col("to") > F.col("budget"), F.struct("digit", (F.col("to") - F.col("words")).alias("before"), "words"))
        found = steps.groupBy("source").agg(F.min(over).alias("edge"), F.max("digit").alias("last"), F.sum("words").alias("all"))
        state = materialize(state.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left").select(
            "s.source", "after", "most_size",
            (F.col("budget") - F.coalesce("edge.before", "all", F.lit(0))).alias("budget"),
            (F.shiftleft("prefix", BITS) + F.coalesce(F.col("edge.digit"), F.col("last") + 1, F.lit(0))).alias("prefix"),
            F.col("edge.words").alias("words"),
        ))
    take = F.coalesce(F.col("words") - F.col("budget") < F.col("budget"), F.lit(False)) if nearer else F.lit(False)
    return state.select(
        "source", (F.col("prefix") - F.when(take, 0).otherwise(1)).alias("upto"),
        (F.col("budget") - F.when(take, F.col("words")).otherwise(0)).alias("left"),
    )


def prefix() -> Column:
    """The bits of the hash that decide."""
    return F.shiftrightunsigned("hash", 64 - BITS * DIGITS)


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source ``copies`` of all its documents, and the documents taken once more.

    Those are of prefixes up to ``upto`` and, to fill what the first that does not fit would leave open, of prefixes up to
    ``upto_small`` if they have at most ``small`` words.
    """
    whole = F.greatest(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(0))
    wants = sources.select(
        "source", whole.cast("long").alias("copies"), (F.col("target") - whole * F.col("source_size")).alias("budget"),
        F.lit(-1).cast("long").alias("after"), F.lit((1 << 63) - 1).alias("most_size"),
    )
    first = threshold(sized, wants.drop("copies"), nearer=False)
    again = first.select(
        "source", F.col("left").alias("budget"), F.col("upto").alias("after"), F.floor("left").cast("long").alias("most_size")
    )
    second = threshold(sized, materialize(again), nearer=True)
    of = lambda name: F.col("s.source").eqNullSafe(F.col(f"{name}.source"))
    return wants.alias("s").join(again.alias("f"), of("f")).join(second.alias("g"), of("g")).select(
        "s.source", "copies", F.col("f.after").alias("upto"), F.col("g.upto").alias("upto_small"), F.col("f.most_size").alias("small")
    )


def doc_hash() -> Column:
    """Of doc_id and text alone."""
    return F.xxhash64("doc_id", "text")


def plan(sized: DataFrame, weights=WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """A stored table by source (``of``): source_size, target and what ``thresholds`` finds for ``sized`` rows."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(with_targets(with_weights(sources, weights), most, share))
    return materialize(sources.alias("s").join(
        thresholds(sized, sources).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select(
        F.col("s.source").alias("of"), "source_size", F.col("target").cast("double").alias("target"),
        F.struct("copies", "upto", "upto_small", "small").alias("plan"),
    ))


def copies(plan_: Column) -> Column:
    """How often the mix takes a row (size, hash) whose source's plan stands beside it."""
    more = (prefix() <= plan_["upto"]) | ((prefix() <= plan_["upto_small"]) & (F.col("size") <= plan_["small"]))
    return plan_["copies"] + more.cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source; others ignored).

    ``size`` counts words of the whole text, 0 for null.  ``taken`` is size times the copies the mix takes, 0 to
    ``most``.  A null source is a source, the last.  The hash depends on doc_id and text alone, so reruns agree and rows that
    repeat in full are taken together.  Empty documents take nothing; an empty table gives an empty result.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash().alias("hash")))
    cuts = plan(sized, weights, most, share)
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies(F.col("plan"))).alias("taken"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns) as the mix takes them: each row as often as it is taken.

    Edge cases as in ``mix``.  Texts stay where they are; only the plan is joined.
    """
    sized = materialize(docs.select("source", word_count(F.col("text")).alias("size"), doc_hash().alias("hash")))
    rows = docs.select(
        whole_row(docs).alias("row of the input"), "source", word_count(F.col("text")).alias("size"), doc_hash().alias("hash")
    )
    taken = rows.join(plan(sized, weights, most, share), F.col("source").eqNullSafe(F.col("of"))).withColumn("n", copies(F.col("plan")))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return taken.where("n > 0").select("row of the input", times.alias("time")).select("row of the input.*")
