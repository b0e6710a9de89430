"""The engine's tables bound to the driver's: videos are labels of embeddings, series are users' events, subtitles are conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.vectors import round_half_away
from spanloom.operators import aggregates, chunking, scoring
from spanloom.operators.joins import members

STEP, FPS = 2.0, 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), r.alias("w_idx"), (r * F.lit(STEP)).alias("t_sec"), F.col("embedding").cast("array<double>").alias("emb"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("video_id")).agg(F.lit(FPS).alias("fps"), (F.count("*") * 60).alias("total_frames"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each video: the mean of its windows."""
    flat = windows(spark, sf_dir).select(F.col("video_id").alias("query_id"), F.posexplode("emb").alias("j", "x")).groupBy("query_id", "j").agg(F.avg("x").alias("x"))
    return flat.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("emb"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.std_chunks(windows(spark, sf_dir), meta(spark, sf_dir), STEP, 1.0)


def chunk_embs(spark: SparkSession, sf_dir: str, method: str = "mean") -> DataFrame:
    w = windows(spark, sf_dir)
    m = members(w, chunks(spark, sf_dir), meta(spark, sf_dir)).join(w, ["video_id", "w_idx"])
    return aggregates.aggregate(m, ["video_id", "chunk_idx"], method)


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, query_id, chunk_idx, start_sec, end_sec, score), scores rounded to six digits."""
    c, m = chunks(spark, sf_dir), meta(spark, sf_dir)
    s = scoring.max_sim(windows(spark, sf_dir), c, m, queries(spark, sf_dir)).withColumn("score", round_half_away(F.col("score")))
    at = c.join(m, "video_id").select("video_id", "chunk_idx", (F.col("start_frame") / F.col("fps")).alias("start_sec"), (F.col("end_frame") / F.col("fps")).alias("end_sec"))
    return s.join(at, ["video_id", "chunk_idx"])


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.relevance(windows(spark, sf_dir), queries(spark, sf_dir), ["video_id", "w_idx"]).withColumn("score", round_half_away(F.col("score")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a query's own video by score."""
    s = scoring.ranked(chunk_scores(spark, sf_dir).where("video_id = query_id"), ["query_id"])
    return s.select("query_id", "rank", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "score")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of twelve seconds for each video."""
    m = meta(spark, sf_dir).withColumn("n", F.col("total_frames") / 60)
    d = m.select(F.col("video_id").alias("query_id"), "n", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("gt_idx"))
    start = STEP * ((F.col("query_id") * 7 + 3) % F.col("n")) * F.when(F.col("gt_idx") == 0, 1.0).otherwise(0.5)
    return d.select("query_id", "gt_idx", start.alias("start"), (start + 12).alias("end"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), (F.col("turn") * 3.0).alias("start_sec"), (F.col("turn") * 3.0 + 2.5).alias("end_sec"), "text")


def talk_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of six seconds of each conversation, and their meta."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg((F.max("turn") + 1).alias("n"))
    m = c.select("video_id", F.lit(FPS).alias("fps"), (F.col("n") * 90).cast("long").alias("total_frames"))
    d = m.select("video_id", "total_frames", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total_frames") / 180) - 1)).alias("chunk_idx"))
    return d.select("video_id", "chunk_idx", (F.col("chunk_idx") * 180).alias("start_frame"), F.least((F.col("chunk_idx") + 1) * 180, F.col("total_frames")).alias("end_frame")), m
