"""Chunks: change points, scenes, transitions, labels and merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.windows import adjacent_similarity, thresholds


def std_boundaries(signal: DataFrame, k: float = 2.0, high: bool = False) -> DataFrame:
    """(video_id, i): where the signal falls under (rises over) its threshold; between windows i and i + 1."""
    t = thresholds(signal, k, high)
    return t.where("value > threshold" if high else "value < threshold").select("video_id", "i")


def scenes(boundaries: DataFrame, windows: DataFrame, meta: DataFrame, step: float) -> DataFrame:
    """(video_id, chunk_idx, start_frame, end_frame) from boundary indices; a boundary is the middle between the two windows' middles."""
    w = Window.partitionBy("video_id").orderBy("w_idx")
    at = windows.select("video_id", "w_idx", "t_sec", F.lead("t_sec").over(w).alias("t_next"))
    b = boundaries.distinct().join(at.where("t_next IS NOT NULL AND w_idx >= 0").withColumnRenamed("w_idx", "i"), ["video_id", "i"]).join(meta, "video_id")
    frame = ((F.col("t_sec") + F.col("t_next") + step) / 2 * F.col("fps")).cast("long")
    cuts = b.select("video_id", frame.alias("end_frame")).where("end_frame > 0").join(meta.select("video_id", "total_frames"), "video_id").where("end_frame < total_frames").select("video_id", "end_frame").distinct()
    cuts = cuts.unionByName(meta.where("total_frames > 0").select("video_id", F.col("total_frames").alias("end_frame")))
    o = Window.partitionBy("video_id").orderBy("end_frame")
    return cuts.select("video_id", (F.row_number().over(o) - 1).alias("chunk_idx"), F.coalesce(F.lag("end_frame").over(o), F.lit(0)).alias("start_frame"), "end_frame")


def std_chunks(windows: DataFrame, meta: DataFrame, step: float, k: float = 2.0) -> DataFrame:
    return scenes(std_boundaries(adjacent_similarity(windows), k), windows, meta, step)


# ---------------------------------------------------------------- change-point kernels


def optimal_partition(cost, n: int, penalty: float, min_size: int, jump: int = 1) -> list[int]:
    """Ends of the segments of the least total cost + penalty for each; ends are multiples of jump, or n. cost(starts, end) gives the costs of segments that end at end."""
    ends = [e for e in range(min_size, n + 1) if e % jump == 0 or e == n]
    best = {0: -penalty}
    back: dict[int, int] = {}
    known = np.array([0])
    value = np.array([-penalty])
    for e in ends:
        ok = e - known >= min_size
        if not ok.any():
            continue
        s, v = known[ok], value[ok]
        total = v + cost(s, e) + penalty
        k = int(np.argmin(total))
        best[e], back[e] = float(total[k]), int(s[k])
        known, value = np.append(known, e), np.append(value, best[e])
    out, e = [], n
    while e and e in back:
        out.append(e)
        e = back[e]
    return out[::-1]


def kernel_change_points(e: np.ndarray, penalty: float | None = None, min_size: int = 2) -> list[int]:
    """Boundaries i (between rows i and i + 1) by the cosine kernel's within-segment cost."""
    n = len(e)
    if n < 2 * min_size:
        return []
    u = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    if penalty is None:
        a = (u[1:] * u[:-1]).sum(axis=1)
        penalty = max(float(a.var()) * 2 * np.log(n), 1e-12)
    s = np.vstack((np.zeros(u.shape[1]), np.cumsum(u, axis=0)))
    own = np.concatenate(([0.0], np.cumsum((u * u).sum(axis=1))))

    def cost(starts: np.ndarray, end: int) -> np.ndarray:
        d = s[end] - s[starts]
        return own[end] - own[starts] - (d * d).sum(axis=1) / (end - starts)

    return [k - 1 for k in optimal_partition(cost, n, penalty, min_size)[:-1]]


def signal_change_points(x: np.ndarray, penalty: float | None = None, min_size: int = 2, jump: int = 5) -> list[int]:
    """Boundaries by squared deviation from segment means of a one-dimensional signal."""
    n = len(x)
    if n < 2 * min_size:
        return []
    if penalty is None:
        penalty = max(float(x.var()) * 2 * np.log(n), 1e-12)
    a, b = (np.concatenate(([0.0], np.cumsum(y))) for y in (x, x * x))
    cost = lambda s, e: b[e] - b[s] - (a[e] - a[s]) ** 2 / (e - s)
    return optimal_partition(cost, n, penalty, min_size, jump)[:-1]


def change_points(windows: DataFrame, penalty: float | None = None, min_size: int = 2, method: str = "kernel_cpd", jump: int = 5) -> DataFrame:
    """(video_id, i): boundaries of each video's windows; one video's windows are one group."""
    if method not in ("kernel_cpd", "pelt"):
        raise ValueError(f"unknown method {method}")
    kind = windows.schema["video_id"].dataType.simpleString()

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w_idx")
        e = np.array(pdf.emb.tolist(), dtype=float)
        if method == "kernel_cpd":
            at = kernel_change_points(e, penalty, min_size)
        else:
            n = np.maximum(np.linalg.norm(e, axis=1), 1e-8)
            at = signal_change_points((e[1:] * e[:-1]).sum(axis=1) / (n[1:] * n[:-1]), penalty, min_size, jump)
        return pd.DataFrame({"video_id": [pdf.video_id.iloc[0]] * len(at), "i": at})

    return windows.select("video_id", "w_idx", "emb").groupBy("video_id").applyInPandas(find, f"video_id {kind}, i int")


# ---------------------------------------------------------------- labels and merges


def label_chunks(chunks: DataFrame, regions: DataFrame, meta: DataFrame) -> DataFrame:
    """(video_id, chunk_idx, start_frame, end_frame, label): chunks cut at transition regions; neighbouring transition segments are one."""
    r = regions.join(meta, "video_id").select("video_id", "start_sec", "end_sec", "fps", "total_frames")
    edge = lambda c: F.least(F.greatest((F.col(c) * F.col("fps")).cast("long"), F.lit(0)), F.col("total_frames"))
    cuts = chunks.select("video_id", F.col("end_frame").alias("f")).unionByName(meta.select("video_id", F.lit(0).cast("long").alias("f"))).unionByName(meta.select("video_id", F.col("total_frames").alias("f")))
    cuts = cuts.unionByName(r.select("video_id", edge("start_sec").alias("f"))).unionByName(r.select("video_id", edge("end_sec").alias("f"))).distinct()
    o = Window.partitionBy("video_id").orderBy("f")
    s = cuts.select("video_id", F.col("f").alias("start_frame"), F.lead("f").over(o).alias("end_frame")).where("end_frame > start_frame").join(meta.select("video_id", "fps"), "video_id")
    s = s.withColumn("_mid", (F.col("start_frame") + F.col("end_frame")) / 2 / F.col("fps"))
    x, y = s.alias("s"), regions.alias("r")
    hit = x.join(y, (F.col("s.video_id") == F.col("r.video_id")) & (F.col("s._mid") >= F.col("r.start_sec")) & (F.col("s._mid") <= F.col("r.end_sec")), "left_semi").select("video_id", "start_frame", F.lit("transition").alias("label"))
    s = s.join(hit, ["video_id", "start_frame"], "left").withColumn("label", F.coalesce("label", F.lit("stable")))
    o = Window.partitionBy("video_id").orderBy("start_frame")
    fresh = ~((F.col("label") == "transition") & (F.coalesce(F.lag("label").over(o), F.lit("")) == "transition"))
    s = s.withColumn("_g", fresh.cast("int")).withColumn("_g", F.sum("_g").over(o))
    out = s.groupBy("video_id", "_g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.first("label").alias("label"))
    return out.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame")) - 1).alias("chunk_idx"), "start_frame", "end_frame", "label")


def cos(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-8))


def merge_short(chunks: list[tuple[int, int, str]], embs: np.ndarray, fps: float, least: float = 5.0, most: float = 60.0) -> tuple[list[tuple[int, int, str]], list[np.ndarray]]:
    """Merges the shortest stable chunk under least seconds into its more alike stable neighbour until none can be; embeddings by duration."""
    at, emb, skip = list(chunks), [np.asarray(e, dtype=float) for e in embs], set()
    while True:
        short = [(c[1] - c[0], k) for k, c in enumerate(at) if c[2] == "stable" and k not in skip and (c[1] - c[0]) / fps < least]
        if not short:
            return at, emb
        _, k = min(short)
        to, alike = None, -1.0
        for j in (k - 1, k + 1):
            if 0 <= j < len(at) and at[j][2] == "stable" and (max(at[j][1], at[k][1]) - min(at[j][0], at[k][0])) / fps <= most and cos(emb[k], emb[j]) > alike:
                to, alike = j, cos(emb[k], emb[j])
        if to is None:
            skip.add(k)
            continue
        a, b = min(k, to), max(k, to)
        da, db = at[a][1] - at[a][0], at[b][1] - at[b][0]
        emb[a : b + 1] = [(emb[a] * da + emb[b] * db) / max(da + db, 1e-12)]
        at[a : b + 1] = [(at[a][0], at[b][1], "stable")]
        skip = set()


def merge_short_chunks(chunks: DataFrame, embs: DataFrame, meta: DataFrame, least: float = 5.0, most: float = 60.0) -> DataFrame:
    """(video_id, chunk_idx, start_frame, end_frame, label) after merge_short, a group for each video."""
    kind = chunks.schema["video_id"].dataType.simpleString()
    d = chunks.join(embs.select("video_id", "chunk_idx", "emb"), ["video_id", "chunk_idx"]).join(meta, "video_id")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        at, _ = merge_short(list(zip(pdf.start_frame, pdf.end_frame, pdf.label, strict=True)), np.array(pdf.emb.tolist()), pdf.fps.iloc[0], least, most)
        return pd.DataFrame([(pdf.video_id.iloc[0], k, *c) for k, c in enumerate(at)], columns=["video_id", "chunk_idx", "start_frame", "end_frame", "label"])

    return d.groupBy("video_id").applyInPandas(merge, f"video_id {kind}, chunk_idx int, start_frame long, end_frame long, label string")


def merge_by_query(chunks: list[tuple[int, int]], embs: np.ndarray, q: np.ndarray, fps: float, threshold: float = 0.05, most: float = 120.0) -> list[tuple[int, int]]:
    """Merges the neighbours whose similarities to the query differ least, while under threshold and most seconds."""
    at, emb = list(chunks), [np.asarray(e, dtype=float) for e in embs]
    sim = [cos(e, q) for e in emb]
    while len(at) > 1:
        gap = [(abs(sim[k] - sim[k + 1]), k) for k in range(len(at) - 1) if (at[k + 1][1] - at[k][0]) / fps <= most]
        if not gap or min(gap)[0] >= threshold:
            break
        k = min(gap)[1]
        a, b = at[k][1] - at[k][0], at[k + 1][1] - at[k + 1][0]
        emb[k : k + 2] = [(emb[k] * a + emb[k + 1] * b) / max(a + b, 1e-12)]
        at[k : k + 2] = [(at[k][0], at[k + 1][1])]
        sim[k : k + 2] = [cos(emb[k], q)]
    return at


def merge_chunks_by_query(chunks: DataFrame, embs: DataFrame, queries: DataFrame, meta: DataFrame, threshold: float = 0.05, most: float = 120.0) -> DataFrame:
    kind, qkind = chunks.schema["video_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    d = chunks.join(embs.select("video_id", "chunk_idx", "emb"), ["video_id", "chunk_idx"]).join(meta, "video_id").crossJoin(F.broadcast(queries.select("query_id", F.col("emb").alias("q"))))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        at = merge_by_query(list(zip(pdf.start_frame, pdf.end_frame, strict=True)), np.array(pdf.emb.tolist()), np.array(pdf.q.iloc[0]), pdf.fps.iloc[0], threshold, most)
        return pd.DataFrame([(pdf.video_id.iloc[0], pdf.query_id.iloc[0], k, *c) for k, c in enumerate(at)], columns=["video_id", "query_id", "chunk_idx", "start_frame", "end_frame"])

    return d.groupBy("video_id", "query_id").applyInPandas(merge, f"video_id {kind}, query_id {qkind}, chunk_idx int, start_frame long, end_frame long")


def uniform_chunks(meta: DataFrame, n: int) -> DataFrame:
    """n chunks of one frame at truncated even positions."""
    step = (F.col("total_frames") - 1) / F.lit(max(n - 1, 1))
    d = meta.select("video_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * step).cast("long"))).alias("chunk_idx", "start_frame"))
    return d.withColumn("end_frame", F.col("start_frame") + 1)


def equal_split(meta: DataFrame, n: int) -> DataFrame:
    d = meta.select("video_id", "total_frames", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_idx"))
    edge = lambda k: (k * F.col("total_frames") / F.lit(n)).cast("long")
    return d.select("video_id", "chunk_idx", edge(F.col("chunk_idx")).alias("start_frame"), edge(F.col("chunk_idx") + 1).alias("end_frame"))


def boundaries_of(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(video_id, t): starts of all chunks but the first, in seconds."""
    return chunks.where("chunk_idx > 0").join(meta, "video_id").select("video_id", (F.col("start_frame") / F.col("fps")).alias("t"))


def grouped_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """At most ``most`` chunks, of neighbours in equal numbers."""
    d = chunks.withColumn("_n", F.count("*").over(Window.partitionBy("video_id")))
    d = d.withColumn("group_idx", F.floor(F.col("chunk_idx") / F.ceil(F.col("_n") / most)).cast("int"))
    return d.groupBy("video_id", "group_idx").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
