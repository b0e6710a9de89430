"""The data behind reports: histograms, trends, example sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n) over 0..1; the last bin is closed."""
    return df.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept) of the least-squares line; nulls under three points."""
    enough = F.count("*") >= 3
    return df.agg(F.count("*").alias("n"), F.when(enough, F.regr_slope(y, x)).alias("slope"), F.when(enough, F.regr_intercept(y, x)).alias("intercept"))


def examples(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """(…, kind): the n worst, of the others the n best, of the rest the first n."""
    worst = df.orderBy(value, order).limit(n).withColumn("kind", F.lit("worst"))
    rest = df.join(worst.select(order), order, "left_anti")
    best = rest.orderBy(F.desc(value), order).limit(n).withColumn("kind", F.lit("best"))
    first = rest.join(best.select(order), order, "left_anti").orderBy(order).limit(n).withColumn("kind", F.lit("first"))
    return worst.unionByName(best).unionByName(first)


def per_flag(df: DataFrame, flag: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(flag).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample_id, kind): where only one of two runs is right."""
    j = a.withColumnRenamed("correct", "a").join(b.withColumnRenamed("correct", "b"), "sample_id").where("a <> b")
    return j.select("sample_id", F.when(F.col("a"), "only_a").otherwise("only_b").alias("kind"))


def segments(boundaries: DataFrame, meta: DataFrame) -> DataFrame:
    """(video_id, start_sec, end_sec): what boundaries part a video into."""
    ends = boundaries.select("video_id", "t").unionByName(meta.select("video_id", (F.col("total_frames") / F.col("fps")).alias("t"))).distinct()
    w = Window.partitionBy("video_id").orderBy("t")
    return ends.select("video_id", F.coalesce(F.lag("t").over(w), F.lit(0.0)).alias("start_sec"), F.col("t").alias("end_sec"))
