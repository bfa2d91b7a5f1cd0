"""Token counts through a digest cache: every distinct text is encoded once.

A text's digest and the digest of the tokenizer file are the key of a stored count.  Texts without a stored count are
encoded, one row for each distinct text, and appended; all documents then read their counts from the store.
Only digests and ids are grouped, so a text that a third of the rows repeat meets in no task.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antecede.llm.tokens import encoder, version
from antecede.session import materialize, work_folder

STORED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("version", T.StringType())])


def _encode(path: str):
    def run(batches):
        count = encoder(path).count
        for batch in batches:
            found: dict[bytes, int] = {}  # rows that repeat in id and text come in several
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in found:
                    found[digest] = count(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["digest", "n_tokens"]
            )

    return run


def stored(spark, cache: str, tokenizer: str) -> DataFrame:
    """Counts kept for this tokenizer; a retried append may have stored one twice, so each digest is taken once."""
    return (
        spark.read.schema(STORED).parquet(cache).where(F.col("version") == version(tokenizer))
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``cache``: a folder every executor can reach, empty or of earlier runs; without one this call starts its own.
    A null text counts as empty (0 bytes, 0 tokens).  Rows with a null or repeated doc_id are counted each; repeated
    rows stay.  An empty table gives an empty result.  Nothing is normalised: counts are those of the text as it is.
    """
    spark = docs.sparkSession
    cache = cache or f"{work_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], STORED).write.mode("append").partitionBy("version").parquet(cache)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    content = materialize(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    first = content.groupBy("digest").agg(F.min("doc_id").alias("id"))
    missing = first.join(stored(spark, cache, tokenizer), "digest", "left_anti")
    chosen = rows.withColumnRenamed("digest", "own").join(
        missing, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id"))
    )
    counted = chosen.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counted.dropDuplicates(["digest"]).withColumn("version", F.lit(version(tokenizer))).write.mode("append").partitionBy("version").parquet(cache)
    # A table of its own, so that Spark can split the join at a digest with very many rows.
    return content.join(materialize(stored(spark, cache, tokenizer)), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
