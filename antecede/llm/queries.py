"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antecede.llm import quality, toxicity
from antecede.llm.html_text import extract
from antecede.llm.id_output import round_trip
from antecede.llm.mixing import mix
from antecede.llm.near_dup import groups
from antecede.llm.packing import pack
from antecede.llm.phrases import phrases, phrases_sql
from antecede.llm.prefix_trie import PREFIX_TRIE_SQL, prefix_trie
from antecede.llm.secret_scan import scan, scan_sql
from antecede.llm.token_counts import token_counts
from antecede.llm.vector_links import links
from antecede.llm.vector_search import search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The public vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe())


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), word_bpe())


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_vector_links": op9_vector_links,
    "op10_vector_search": op10_vector_search,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_token_ids": op13_token_ids,
}

ORACLES: dict[str, str] = {"op1_secrets": scan_sql(), "op11_prefix_trie": PREFIX_TRIE_SQL, "op12_phrases": phrases_sql()}
