"""The queries of the ten operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import toxicity
from spanloom.llm.common import table
from spanloom.llm.decontaminate import find_leaks
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.lm_score import score_texts
from spanloom.llm.minhash import near_duplicates
from spanloom.llm.mixing import mix, training_order
from spanloom.llm.suffix_dedup import dedup_substrings
from spanloom.llm.tokens import count_tokens
from spanloom.llm.url_filter import Rule, filter_urls
from spanloom.llm.vectors import near_vectors

URL_RULES = [Rule.of("net/", "block"), Rule.of("example.net/en/", "allow"), Rule.of("example.com/de/", "block"), Rule.of("org/fr/", "allow")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def third(id_col: str = "doc_id"):
    """Column: the remainder by 3 of the CRC-32 of an id's text; null without id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), third() != 1)
    held = F.coalesce(third() == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = count_tokens(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_tokens", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"), F.transform("section_tokens", lambda x: x.cast("long")).alias("section_tokens"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    d = score_texts(table(spark, sf_dir, "documents"), F.coalesce(fifth != 1, F.lit(True)))
    return d.select("doc_id", F.coalesce(fifth == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = training_order(mix(table(spark, sf_dir, "documents")), untaken=True).where("copy = 0 OR copy IS NULL")  # a second copy follows a whole first one
    return d.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("first_position"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_substrings(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_score": op7_lm_score,
    "op8_mix_sources": op8_mix_sources,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
}
