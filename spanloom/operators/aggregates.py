"""Chunk vectors from member windows: means over dimensions, as aggregates that combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.vectors import dot, doubles, l2_normalize, norm

METHODS = ("mean", "gem", "coherence_mean", "lse", "max_sim")


def _collected(per_dim: DataFrame, keys: list[str]) -> DataFrame:
    return per_dim.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_x"))), lambda s: s["_x"]).alias("emb"))


def aggregate(rows: DataFrame, keys: list[str], method: str = "mean", p: float = 3.0, tau: float = 10.0) -> DataFrame:
    """(keys, emb, coherence) of rows with emb. coherence is the length of the mean, whatever the method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "gem" and p <= 0 or method == "lse" and tau <= 0:
        raise ValueError("p and tau must be positive")
    d = rows.select(*keys, doubles(F.col("emb")).alias("_e"))
    flat = d.select(*keys, F.posexplode("_e").alias("_j", "_v"))
    mean = _collected(flat.groupBy(*keys, "_j").agg(F.avg("_v").alias("_x")), keys)
    coherence = mean.select(*keys, norm(F.col("emb")).alias("coherence"))
    if method == "mean":
        return mean.select(*keys, l2_normalize(F.col("emb")).alias("emb"), norm(F.col("emb")).alias("coherence"))
    if method == "max_sim":
        return mean.select(*keys, F.transform("emb", lambda x: x / (norm(F.col("emb")) + 1e-8)).alias("emb"), norm(F.col("emb")).alias("coherence"))
    if method == "gem":
        m = flat.groupBy(*keys, "_j").agg(F.avg(F.signum("_v") * F.pow(F.abs("_v"), F.lit(p))).alias("_m"))
        out = _collected(m.withColumn("_x", F.signum("_m") * F.pow(F.abs("_m"), F.lit(1 / p))), keys)
    elif method == "lse":
        top = flat.withColumn("_t", F.max("_v").over(Window.partitionBy(*keys, "_j")))
        out = _collected(top.groupBy(*keys, "_j").agg((F.max("_t") + F.log(F.avg(F.exp(tau * (F.col("_v") - F.col("_t"))))) / tau).alias("_x")), keys)
    else:
        out = _coherent(d, keys, tau)
    return out.select(*keys, l2_normalize(F.col("emb")).alias("emb")).join(coherence, keys)


def _coherent(d: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """Rows weighted by how alike they are to the others of their group (pairs of a chunk's windows, which a chunk's length bounds)."""
    n = d.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_e")))
    other = n.select(*keys, F.col("_e").alias("_f"))
    logits = n.join(other, keys).withColumn("_l", tau * dot(F.col("_e"), F.col("_f")))
    w = logits.groupBy(*keys, "_i").agg(F.max("_l").alias("_m"), F.collect_list("_l").alias("_ls"), F.first("_e").alias("_e"))
    w = w.withColumn("_w", F.aggregate("_ls", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m"))))
    w = w.withColumn("_w", F.col("_w") / F.sum("_w").over(Window.partitionBy(*keys)))
    flat = w.select(*keys, "_w", F.posexplode("_e").alias("_j", "_v"))
    return _collected(flat.groupBy(*keys, "_j").agg(F.sum(F.col("_w") * F.col("_v")).alias("_x")), keys)
