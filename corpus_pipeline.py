"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are blotted out, sources are
mixed to their weights, and what is left is packed into windows.

Every stage works on the documents that the one before kept; its result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antecede.llm import mixing, near_dup, packing, secret_scan, toxicity
from antecede.llm.queries import byte_bpe, table
from antecede.llm.rows import exact, free_name
from antecede.session import materialize

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the labels are those of the corpus.

    Null and empty texts have a score like any other, rows that repeat go or stay together, any other column comes along whatever
    its name, texts are read whole, and no document gives no document.  So it is in all stages but where they say otherwise.
    """
    name = free_name(docs, "toxicity of the text")
    scored = toxicity.with_scores(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.where(exact(name) < TOXIC).select(*map(exact, docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; of rows that repeat one stays, a null id comes last."""
    return near_dup.one_of_each(docs)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark and n_chars follows; a null text stays null, and no document goes."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows; one without words counts nothing, a null source is a source."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places, not documents: each of a document's ids in one piece; a null text is its end alone."""
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each_group),
    ("secrets", blot_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: SQL expresses neither the models nor the packing; tests/llm holds every stage against brute force on its own input.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
