"""Scores of chunks and windows for queries, ranks, gallery search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.vectors import cosine, doubles
from spanloom.operators.joins import members

#: Bytes of query vectors that go to all tasks at once; more go in parts.
QUERY_BYTES = 64 << 20


def relevance(items: DataFrame, queries: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, query_id, score): cosine of every item with every query. Queries are a stated set: they go to the tasks in parts of at most QUERY_BYTES, and items stream by in blocks."""
    spark = items.sparkSession
    n = queries.count()
    width = queries.select(F.max(F.size("emb"))).first()[0] or 1
    parts = 1 + n * width * 8 // QUERY_BYTES
    qkind = queries.schema["query_id"].dataType.simpleString()
    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in keep)
    out = None
    for p in range(parts):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).select("query_id", "emb").orderBy("query_id").collect()
        q = np.array([r.emb for r in some], dtype=float).reshape(len(some), -1)
        sent = spark.sparkContext.broadcast(([r.query_id for r in some], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-8) if len(q) else q))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for pdf in batches:
                if not len(pdf) or not ids:
                    continue
                e = np.array(pdf.emb.tolist(), dtype=float)
                s = (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-8)) @ q.T
                out = pdf[keep].loc[pdf.index.repeat(len(ids))].reset_index(drop=True)
                yield out.assign(query_id=np.tile(ids, len(pdf)), score=s.ravel())

        got = items.select(*keep, "emb").mapInPandas(score, f"{kinds}, query_id {qkind}, score double")
        out = got if out is None else out.unionByName(got)
    return out


def max_sim(windows: DataFrame, chunks: DataFrame, meta: DataFrame, queries: DataFrame) -> DataFrame:
    """(video_id, query_id, chunk_idx, score): the best cosine over a chunk's windows."""
    s = relevance(windows, queries, ["video_id", "w_idx"])
    return members(windows, chunks, meta).join(s, ["video_id", "w_idx"]).groupBy("video_id", "query_id", "chunk_idx").agg(F.max("score").alias("score"))


def single_vector(chunk_embs: DataFrame, queries: DataFrame) -> DataFrame:
    return relevance(chunk_embs, queries, ["video_id", "chunk_idx"]).select("video_id", "query_id", "chunk_idx", "score")


def native_relevance(items: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(…, score) where items and queries meet on keys: a Column expression, for few pairs for each row."""
    q = queries.withColumnRenamed("emb", "_q")
    return items.join(q, keys).withColumn("score", cosine(doubles(F.col("emb")), doubles(F.col("_q")))).drop("_q", "emb")


def ranked(scores: DataFrame, keys: list[str], order: str = "chunk_idx", top: int | None = None) -> DataFrame:
    """scores with rank from 1 by score, then by order."""
    d = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order)))
    return d.where(F.col("rank") <= top) if top else d


def preselected(scores: DataFrame, keys: list[str], top: int, order: str = "chunk_idx") -> DataFrame:
    """The best top rows, numbered in order of time."""
    return ranked(scores, keys, order, top).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def round_robin(scores: DataFrame, keys: list[str], n_frames: int, order: str = "w_idx") -> DataFrame:
    """(…, frames): n_frames dealt to a group's rows in the order of their scores."""
    d = ranked(scores, keys, order).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    frames = F.floor(F.lit(n_frames) / F.col("_n")) + (F.col("rank") <= F.lit(n_frames) % F.col("_n")).cast("int")
    return d.withColumn("frames", frames.cast("int")).drop("_n")


def neighbours(scores: DataFrame, keys: list[str], n: int, order: str = "w_idx") -> DataFrame:
    """(…, step): the best row, those after it to the end, then those before it, n in all."""
    d = ranked(scores, keys, order)
    best = F.min(F.when(F.col("rank") == 1, F.col(order))).over(Window.partitionBy(*keys))
    d = d.withColumn("_b", best)
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order) < F.col("_b"), F.abs(F.col(order) - F.col("_b"))))
    return d.withColumn("step", step).where(F.col("step") <= n).drop("_b", "rank")


def allowed_chunks(max_chunks: int, max_images: int, frames_per_chunk: int) -> int:
    if min(max_chunks, max_images, frames_per_chunk) <= 0:
        raise ValueError("budgets must be positive")
    if frames_per_chunk > max_images:
        raise ValueError("a chunk's frames exceed the images of a request")
    return min(max_chunks, max_images // frames_per_chunk)


def gallery(items: DataFrame, queries: DataFrame, item_id: str, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k best items of each query."""
    s = relevance(items, queries, [item_id])
    return ranked(s, ["query_id"], item_id, k)
