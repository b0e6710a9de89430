"""Interval, nearest and as-of joins. All have an equality key, so that they shuffle on it instead of pairing everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows_to_chunks(windows: DataFrame, chunks: DataFrame, meta: DataFrame, bin_sec: float | None = None) -> DataFrame:
    """windows with chunk_idx: the last chunk that holds the window's start (half-open), -1 without one. bin_sec deals long videos into bins of time."""
    c = chunks.join(meta.select("video_id", "fps"), "video_id").select("video_id", "chunk_idx", (F.col("start_frame") / F.col("fps")).alias("_s"), (F.col("end_frame") / F.col("fps")).alias("_e"))
    key = ["video_id"]
    if bin_sec:
        key = ["video_id", "_bin"]
        c = c.where("_e > _s").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / bin_sec), F.floor(F.col("_e") / bin_sec))))
        windows = windows.withColumn("_bin", F.floor(F.col("t_sec") / bin_sec))
    hit = windows.select(*key, "w_idx", "t_sec").join(c, key).where("t_sec >= _s AND t_sec < _e").groupBy("video_id", "w_idx").agg(F.max("chunk_idx").alias("chunk_idx"))
    return windows.join(hit, ["video_id", "w_idx"], "left").withColumn("chunk_idx", F.coalesce("chunk_idx", F.lit(-1))).drop("_bin")


def members(windows: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """(video_id, chunk_idx, w_idx): windows that start in a chunk (half-open); a chunk without any has the one nearest to its middle, the earlier on ties."""
    c = chunks.join(meta.select("video_id", "fps"), "video_id").select("video_id", "chunk_idx", (F.col("start_frame") / F.col("fps")).alias("_s"), (F.col("end_frame") / F.col("fps")).alias("_e"))
    w = windows.select("video_id", "w_idx", "t_sec")
    inside = c.join(w, "video_id").where("t_sec >= _s AND t_sec < _e").select("video_id", "chunk_idx", "w_idx")
    bare = c.join(inside, ["video_id", "chunk_idx"], "left_anti").join(w, "video_id")
    near = bare.groupBy("video_id", "chunk_idx").agg(F.min(F.struct(F.abs(F.col("t_sec") - (F.col("_s") + F.col("_e")) / 2).alias("d"), "w_idx"))["w_idx"].alias("w_idx"))
    return inside.unionByName(near)


def overlapping(chunks: DataFrame, meta: DataFrame, subtitles: DataFrame, offset: float = 0.0) -> DataFrame:
    """(video_id, chunk_idx, text): subtitles that touch a chunk (closed at both ends), each text once in the order of appearance, joined by spaces."""
    c = chunks.join(meta.select("video_id", "fps"), "video_id").select("video_id", "chunk_idx", (F.col("start_frame") / F.col("fps")).alias("_s"), (F.col("end_frame") / F.col("fps")).alias("_e"))
    j = c.join(subtitles, "video_id").where((F.col("start_sec") - offset <= F.col("_e")) & (F.col("end_sec") - offset >= F.col("_s")))
    once = j.groupBy("video_id", "chunk_idx", "text").agg(F.min(F.struct("start_sec", "end_sec")).alias("o"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"])
    return once.groupBy("video_id", "chunk_idx").agg(F.array_join(lines, " ").alias("text"))


def aligned(subtitles: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Subtitles that touch any chunk, once for each rounded interval and text."""
    c = chunks.join(meta.select("video_id", "fps"), "video_id").select(F.col("video_id").alias("_v"), (F.col("start_frame") / F.col("fps")).alias("_s"), (F.col("end_frame") / F.col("fps")).alias("_e"))
    s = subtitles.join(c, (F.col("video_id") == F.col("_v")) & (F.col("start_sec") <= F.col("_e")) & (F.col("end_sec") >= F.col("_s")), "left_semi")
    return s.withColumn("start_sec", F.round("start_sec", 3)).withColumn("end_sec", F.round("end_sec", 3)).select("video_id", "start_sec", "end_sec", "text").distinct()


def around(points: DataFrame, subtitles: DataFrame, reach: float = 3.0) -> DataFrame:
    """(video_id, t, text): subtitles within reach of a time, in order, joined by spaces."""
    j = points.select("video_id", "t").join(subtitles, "video_id").where((F.col("start_sec") <= F.col("t") + reach) & (F.col("end_sec") >= F.col("t") - reach))
    return j.groupBy("video_id", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "text"))), lambda x: x["text"]), " ").alias("text"))


def bracket(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(video_id, t, left_idx, right_idx): the grid points before or at t, and after it; an as-of join by two sorts of both sides, one running value each."""
    both = points.select("video_id", "t", F.lit(1).alias("_p"), F.lit(None).cast("long").alias("_i")).unionByName(grid.select("video_id", F.col("center").alias("t"), F.lit(0).alias("_p"), F.col("w_idx").cast("long").alias("_i")))
    before = Window.partitionBy("video_id").orderBy("t", "_p", "_i").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("_p"), F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # read backward, as a frame that shrinks is gone through again for each row
    both = both.withColumn("left_idx", F.last("_i", True).over(before)).withColumn("right_idx", F.last("_i", True).over(after))
    return both.where("_p = 1").select("video_id", "t", "left_idx", "right_idx")


def nearest(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(video_id, t, w_idx): the grid point nearest to t, the earlier on ties; of the two that bracket it."""
    b = bracket(points.distinct(), grid)
    g = grid.select("video_id", F.col("w_idx").cast("long").alias("_i"), "center")
    left = b.join(g.withColumnsRenamed({"_i": "left_idx", "center": "_l"}), ["video_id", "left_idx"], "left")
    both = left.join(g.withColumnsRenamed({"_i": "right_idx", "center": "_r"}), ["video_id", "right_idx"], "left")
    near = F.when(F.col("_r").isNull() | (F.col("t") - F.col("_l") <= F.col("_r") - F.col("t")), F.col("left_idx")).otherwise(F.col("right_idx"))
    return both.select("video_id", "t", near.alias("w_idx"))
