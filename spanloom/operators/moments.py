"""Moments: subsets of scored chunks. Scores come as (video_id, query_id, chunk_idx, start_sec, end_sec, score)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.windows import islands

KEYS = ["video_id", "query_id"]


def merged_runs(scores: DataFrame, flag) -> DataFrame:
    """(keys, start_sec, end_sec, score): runs of chunks where flag holds, with their best score."""
    runs = islands(scores, KEYS, ["chunk_idx"], flag)
    return runs.groupBy(*KEYS, "island").agg(F.min("chunk_idx").alias("_c"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("score").alias("score"))


def top_gap(scores: DataFrame, gap: float = 0.05) -> DataFrame:
    """Runs of chunks within gap of the best, then every other chunk by itself; rank counts through, is_selected tells them apart."""
    s = scores.withColumn("_keep", F.col("score") >= F.max("score").over(Window.partitionBy(*KEYS)) - gap)
    chosen = merged_runs(s, F.col("_keep")).select(*KEYS, "start_sec", "end_sec", "score", "_c", F.lit(True).alias("is_selected"))
    rest = s.where(~F.col("_keep")).select(*KEYS, "start_sec", "end_sec", "score", F.col("chunk_idx").alias("_c"), F.lit(False).alias("is_selected"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("is_selected"), F.desc("score"), "_c")
    return chosen.unionByName(rest).withColumn("rank", F.row_number().over(order)).drop("_c")


def score_drop(scores: DataFrame) -> DataFrame:
    """Runs of the chunks above the largest gap between sorted scores (the first such gap)."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "chunk_idx")
    d = scores.withColumn("_r", F.row_number().over(order)).withColumn("_g", F.col("score") - F.lead("score").over(order))
    cut = d.groupBy(*KEYS).agg(F.coalesce(F.max_by("score", F.struct(F.col("_g"), -F.col("_r"))), F.min("score")).alias("_cut"), F.count("*").alias("_n"))
    s = scores.join(cut, KEYS)
    runs = merged_runs(s, F.col("score") >= F.col("_cut"))
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "_c"))).drop("_c", "island")


def penalized_runs(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float | None = None, factor: float = 1.0, most: float | None = None) -> list[tuple[int, int]]:
    """Runs (first, last) that maximise centred scores less a threshold for each run.

    One scan: a run that begins at i and ends before j adds (best of i - prefix of i) + prefix of j - threshold, so only the largest first part among the allowed beginnings counts.  With a longest
    duration beginnings leave in order, and the largest of those that are left stands in front of a queue of falling values: O(chunks) either way.  A gain counts from 1e-9 on; the earliest beginning wins.
    """
    x = scores.astype(np.float32).astype(float)
    threshold = penalty if penalty is not None else float(x.std()) * factor * np.sqrt(2 * np.log(max(len(x), 2)))
    prefix = np.append(0.0, np.cumsum(x - x.mean()))
    queue: deque[tuple[float, int]] = deque()
    state: tuple[float, tuple] = (0.0, ())  # the best sum so far, and its runs as a chain (earlier chain, first, last)
    chains = []
    for j in range(len(x)):
        chains.append(state)
        first_part = state[0] - prefix[j]
        while queue and first_part > queue[-1][0] + 1e-9:
            queue.pop()
        queue.append((first_part, j))
        while most is not None and queue and ends[j] - starts[queue[0][1]] > most:
            queue.popleft()
        if queue and queue[0][0] + prefix[j + 1] - threshold > state[0] + 1e-9:
            gain, i = queue[0]
            state = (gain + prefix[j + 1] - threshold, (chains[i][1], i, j))
    out, chain = [], state[1]
    while chain:
        chain, *run = chain
        out.append(tuple(run))
    return out[::-1]


def penalized_dp(scores: DataFrame, penalty: float | None = None, factor: float = 1.0, most: float | None = None) -> DataFrame:
    v, q = (scores.schema[c].dataType.simpleString() for c in KEYS)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx").reset_index(drop=True)
        runs = penalized_runs(pdf.score.to_numpy(), pdf.start_sec.to_numpy(), pdf.end_sec.to_numpy(), penalty, factor, most)
        rows = sorted(((pdf.start_sec[a], pdf.end_sec[b], pdf.score[a : b + 1].max()) for a, b in runs), key=lambda r: -r[2])
        return pd.DataFrame([(pdf.video_id[0], pdf.query_id[0], *r, k + 1) for k, r in enumerate(rows)], columns=[*KEYS, "start_sec", "end_sec", "score", "rank"])

    return scores.groupBy(*KEYS).applyInPandas(select, f"video_id {v}, query_id {q}, start_sec double, end_sec double, score double, rank int")


def select_moments(scores: DataFrame, method: str = "penalized_dp", **params) -> DataFrame:
    """Moments by method; a group without any falls back to all its chunks by score."""
    how = {"penalized_dp": penalized_dp, "top_gap": top_gap, "score_drop": score_drop}
    if method not in how:
        raise ValueError(f"unknown method {method}")
    got = how[method](scores, **params).select(*KEYS, "start_sec", "end_sec", "score", "rank")
    order = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "chunk_idx")
    rest = scores.join(got.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("rank", F.row_number().over(order))
    return got.unionByName(rest.select(*KEYS, "start_sec", "end_sec", "score", "rank"))


def diagnostics(scores: DataFrame, moments: DataFrame) -> DataFrame:
    s = scores.groupBy(*KEYS).agg(F.count("*").alias("num_chunks"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))
    return s.join(moments.groupBy(*KEYS).agg(F.count("*").alias("num_moments")), KEYS, "left").withColumn("num_moments", F.coalesce("num_moments", F.lit(0)))
