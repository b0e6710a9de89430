"""A corpus pipeline of five stages, each written as Parquet and read again.

Toxic documents go; later occurrences of repeated line windows go from the texts; of each group of near duplicates one document stays; documents that hold a benchmark item go; what is left is
mixed to the sources' target weights, in training order.  Stages before the last return the columns of documents.

Nulls, empty and repeated rows: a document without text passes every stage but the mix, which takes nothing from it; a document without id is never a near duplicate and never
leaves as one; rows that repeat an id are one document to the near-duplicate stage, which keeps the row of the least text; an empty table stays empty.  Other columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import toxicity
from spanloom.llm.common import Scratch, table
from spanloom.llm.decontaminate import find_leaks
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.minhash import near_duplicates
from spanloom.llm.mixing import mix, training_order
from spanloom.llm.queries import third

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression-distance classifier doesn't reject. It learns from the labels of the rows that are left (and, as the query does, of two thirds of the ids)."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), third() != 1)
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that occur earlier; n_chars follows the text."""
    d = dedup_lines(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return d.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    some = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("d")).select("doc_id", "d.*")
    return some.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; of those without id, all."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, by training position; a copy that is taken in part is cut after its take_words words."""
    flat = training_order(mix(docs, keep=("text", "lang")))
    space = "[ \\t\\n\\x0B\\f\\r]"
    words = F.slice(F.split("text", f"(?<!{space})(?={space})"), F.lit(1), F.greatest(F.lit(1), F.col("take_words")).cast("int"))  # each with the white space before it
    text = F.when(F.col("take_words") < F.col("size"), F.array_join(words, "")).otherwise(F.col("text"))
    return flat.select("doc_id", "copy", "position", "take_words", "size", "source", "lang", text.alias("text"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix_sources)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.settle()
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
