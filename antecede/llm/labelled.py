"""Labelled rows for the two classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.session import materialize

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from: crc32 of the id as text is divisible by ``FOLDS``.  Null: not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, most: int) -> tuple[DataFrame, float]:
    """A stored table of doc_id and y, at most ``most`` rows of each class, and the share of ones among all labels.

    Only rows that are not held out and whose id and label are not null.  An id with both labels counts as 1.  The rows taken are
    those of the smallest hash, so a run over the same labels takes the same.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        "doc_id IS NOT NULL AND y IN (0, 1)"
    )
    known = materialize(known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")))
    share = known.agg(F.avg("y")).first()[0]
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return materialize(drawn[0].union(drawn[1])), 0.5 if share is None else float(share)
