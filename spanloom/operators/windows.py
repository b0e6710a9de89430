"""Window grids and time series per key, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.vectors import cosine, doubles


def window_grid(meta: DataFrame, step: float) -> DataFrame:
    """(video_id, w_idx, start_sec, end_sec): windows of step seconds; the last one ends with the video."""
    duration = F.col("total_frames") / F.col("fps")
    n = F.ceil(duration / step).cast("int")
    g = meta.where(n > 0).select("video_id", duration.alias("_d"), F.explode(F.sequence(F.lit(0), n - 1)).alias("w_idx"))
    return g.select("video_id", "w_idx", (F.col("w_idx") * F.lit(step)).alias("start_sec"), F.least((F.col("w_idx") + 1) * F.lit(step), F.col("_d")).alias("end_sec"))


def _steps(windows: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("w_idx")
    return windows.select("video_id", "w_idx", "t_sec", (F.col("t_sec") - F.lag("t_sec").over(w)).alias("step"))


def first_interval(windows: DataFrame) -> DataFrame:
    """(video_id, interval): the first positive step between windows."""
    return _steps(windows).groupBy("video_id").agg(F.min_by("step", F.when(F.col("step") > 0, F.col("w_idx"))).alias("interval"))


def median_interval(windows: DataFrame) -> DataFrame:
    return _steps(windows).where("step > 0").groupBy("video_id").agg(F.median("step").alias("interval"))


def adjacent_similarity(windows: DataFrame) -> DataFrame:
    """(video_id, i, t_sec, value): cosine of window i and the next, at the next one's start."""
    w = Window.partitionBy("video_id").orderBy("w_idx")
    d = windows.select("video_id", "w_idx", "t_sec", doubles(F.col("emb")).alias("e")).withColumn("p", F.lag("e").over(w))
    return d.where("p IS NOT NULL").select("video_id", (F.col("w_idx") - 1).alias("i"), "t_sec", cosine(F.col("p"), F.col("e")).alias("value"))


def smooth_zero(df: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """Moving average with zeros beyond the ends; nothing for series shorter than width. An even width reaches one further back."""
    w = Window.partitionBy(key).orderBy(*order)
    back, ahead = width // 2, width - 1 - width // 2
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).where(F.col("_n") >= width).withColumn("smooth", F.sum(value).over(w.rowsBetween(-back, ahead)) / width).drop("_n")


def smooth_edge(df: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """Moving average that repeats the end values; unchanged for two values or a width of one."""
    w, whole = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    d = df.withColumn("_n", F.count("*").over(whole)).withColumn("_r", F.row_number().over(w) - 1)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumn("_a", first).withColumn("_z", last).withColumn("_w", F.least(F.lit(width), F.col("_n")).cast("int"))
    left, right = F.floor(F.col("_w") / 2).cast("int"), F.col("_w") - 1 - F.floor(F.col("_w") / 2).cast("int")
    inner = F.transform(F.collect_list(F.struct(F.col("_r").alias("r"), F.col(value).cast("double").alias("v"))).over(w.rowsBetween(-(width // 2), width - 1)), lambda x: x)
    d = d.withColumn("_in", inner)
    total = F.aggregate(F.filter("_in", lambda x: (x["r"] >= F.col("_r") - left) & (x["r"] <= F.col("_r") + right)), F.lit(0.0), lambda s, x: s + x["v"])
    low, high = F.greatest(F.lit(0), left - F.col("_r")), F.greatest(F.lit(0), F.col("_r") + right - F.col("_n") + 1)
    mean = (total + low * F.col("_a") + high * F.col("_z")) / F.col("_w")
    return d.withColumn("smooth", F.when((F.col("_n") <= 2) | (F.col("_w") <= 1), F.col(value).cast("double")).otherwise(mean)).drop("_n", "_r", "_a", "_z", "_w", "_in")


def islands(df: DataFrame, key: list[str], order: list[str], flag: Column) -> DataFrame:
    """The rows where flag holds, with island: a number that runs of neighbours share."""
    w = Window.partitionBy(*key)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(flag)
    return d.withColumn("island", F.col("_r") - F.row_number().over(w.orderBy(*order))).drop("_r")


def regions(signal: DataFrame, low: Column, min_sec: float = 1.0) -> DataFrame:
    """(video_id, start_sec, end_sec): maximal runs of signal rows where low holds, of min_sec at least."""
    runs = islands(signal, ["video_id"], ["i"], low).groupBy("video_id", "island").agg(F.min("t_sec").alias("start_sec"), F.max("t_sec").alias("end_sec"))
    return runs.where(F.col("end_sec") - F.col("start_sec") >= min_sec).drop("island")


def thresholds(signal: DataFrame, k: float, high: bool = False) -> DataFrame:
    """signal with its key's threshold: mean - k * population deviation (plus for high)."""
    w = Window.partitionBy("video_id")
    return signal.withColumn("threshold", F.avg("value").over(w) + (k if high else -k) * F.stddev_pop("value").over(w))


def peaks(df: DataFrame, key: str, order: list[str], value: str, beta: float = 0.75) -> DataFrame:
    """(key, idx, strength): local maxima of absolute steps that reach mean + beta * population deviation."""
    w, whole = Window.partitionBy(key).orderBy("_r"), Window.partitionBy(key)
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    d = d.withColumn("strength", F.abs(F.lead(value).over(w) - F.col(value))).where("strength IS NOT NULL")
    d = d.withColumn("_t", F.avg("strength").over(whole) + beta * F.stddev_pop("strength").over(whole))
    d = d.withColumn("_p", F.coalesce(F.lag("strength").over(w), F.lit(float("-inf")))).withColumn("_q", F.coalesce(F.lead("strength").over(w), F.lit(float("-inf"))))
    return d.where("strength >= _t AND strength >= _p AND strength >= _q").select(key, (F.col("_r") + 1).alias("idx"), "strength")
