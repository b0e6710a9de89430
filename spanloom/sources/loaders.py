"""Sources as DataFrame plans: nested JSON, subtitles, question files. Texts are parsed where they are read, by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import letter, lettered, parse_timestamp, strip_tags


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files as text."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")


def windows_of(pairs) -> F.Column:
    """ARRAY<ARRAY<DOUBLE>> to ARRAY<STRUCT<start, end>>."""
    return F.transform(pairs, lambda w: F.struct(w[0].alias("start"), w[1].alias("end")))


def highlights(raw: DataFrame) -> DataFrame:
    """Samples of one JSON object for each line (value)."""
    kind = "qid long, query string, vid string, duration double, relevant_windows array<array<double>>, relevant_clip_ids array<int>, saliency_scores array<array<double>>"
    x = raw.select(F.from_json("value", kind).alias("x"))
    return x.select(F.col("x.qid").cast("string").alias("sample_id"), F.col("x.vid").alias("video_id"), "x.query", windows_of(F.col("x.relevant_windows")).alias("gt_windows"), "x.duration", "x.relevant_clip_ids", "x.saliency_scores")


def captions(raw: DataFrame) -> DataFrame:
    """Samples of objects {video: {duration, timestamps, sentences}}; the two arrays meet by position, to the shorter."""
    kind = "map<string, struct<duration: double, timestamps: array<array<double>>, sentences: array<string>>>"
    v = raw.select(F.explode(F.from_json("value", kind)).alias("video_id", "x"))
    p = v.select("video_id", "x.duration", F.least(F.size("x.timestamps"), F.size("x.sentences")).alias("n"), F.posexplode(F.arrays_zip("x.timestamps", "x.sentences")).alias("i", "z")).where("i < n")
    return p.select(F.concat_ws("_", "video_id", "i").alias("sample_id"), "video_id", F.trim("z.sentences").alias("query"), F.col("z.timestamps")[0].alias("start"), F.col("z.timestamps")[1].alias("end"), "duration")


def nested_queries(raw: DataFrame) -> DataFrame:
    """Samples of videos > clips > annotations > language_queries, numbered over all that have a query.

    The number runs over the whole input, so its last step sorts (doc, positions) in one task; only rows of this source pass it.
    """
    kind = "videos array<struct<video_uid: string, clips: array<struct<clip_uid: string, annotations: array<struct<language_queries: array<struct<query: string, clip_start_sec: double, clip_end_sec: double>>>>>>>>"
    v = raw.select("doc", F.posexplode(F.from_json("value", f"struct<{kind.replace('videos array', 'videos: array', 1)}>")["videos"]).alias("a", "v"))
    c = v.select("doc", "a", "v.video_uid", F.posexplode("v.clips").alias("b", "c"))
    n = c.select("doc", "a", "b", "video_uid", "c.clip_uid", F.posexplode("c.annotations").alias("e", "n"))
    q = n.select("doc", "a", "b", "e", "video_uid", "clip_uid", F.posexplode("n.language_queries").alias("f", "q")).where("q.query IS NOT NULL")
    from pyspark.sql import Window

    k = F.row_number().over(Window.orderBy("doc", "a", "b", "e", "f")) - 1
    return q.select(F.concat_ws("_", "clip_uid", k).alias("sample_id"), "video_uid", "clip_uid", F.col("q.query").alias("query"), F.col("q.clip_start_sec").alias("start"), F.col("q.clip_end_sec").alias("end"))


def question_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return questions.join(answers, "question_id").select("question_id", F.concat(F.lit("v_"), "video_name").alias("video_id"), "question", F.col("answer").alias("gt_answer"), F.col("type").alias("answer_type"))


def multiple_choice(raw: DataFrame) -> DataFrame:
    """Samples of {id, question, candidates, correct_choice}: options with letters, the right letter; none without candidates."""
    x = raw.select(F.from_json("value", "id string, question string, candidates array<string>, correct_choice int").alias("x")).select("x.*")
    x = x.where(F.size(F.filter("candidates", lambda c: F.trim(c) != "")) > 0)
    return x.select(F.col("id").alias("sample_id"), F.trim("question").alias("query"), lettered(F.col("candidates")).alias("options"), letter(F.col("correct_choice")).alias("gt_answer"))


def srt(raw: DataFrame) -> DataFrame:
    """(video_id, start_sec, end_sec, text) of SRT texts: blocks by blank lines, with or without a number."""
    b = raw.select("video_id", F.explode(F.split("value", "\\r?\\n[ \\t]*\\r?\\n")).alias("b")).where("b LIKE '%-->%'")
    line = F.regexp_extract("b", "([^\\n]*-->[^\\n]*)", 1)
    side = F.split(line, "-->")
    text = strip_tags(F.regexp_replace("b", "(?s)^.*?-->[^\\n]*(\\n|$)", ""))
    return b.select("video_id", parse_timestamp(F.trim(side[0])).alias("start_sec"), parse_timestamp(F.trim(side[1])).alias("end_sec"), text.alias("text")).where("text <> ''")


def json_subtitles(raw: DataFrame) -> DataFrame:
    """(video_id, start_sec, end_sec, text) of [{timestamp: [s, e], text}] or [{start, end, line or text}]."""
    x = raw.select("video_id", F.explode(F.from_json("value", "array<struct<timestamp: array<string>, start: string, end: string, line: string, text: string>>")).alias("x"))
    sec = lambda c: F.when(c.contains(":"), parse_timestamp(c)).otherwise(c.cast("double"))
    start, end = F.coalesce(F.col("x.timestamp")[0], F.col("x.start")), F.coalesce(F.col("x.timestamp")[1], F.col("x.end"))
    return x.select("video_id", sec(start).alias("start_sec"), sec(end).alias("end_sec"), strip_tags(F.coalesce("x.line", "x.text")).alias("text")).where("text <> ''")


# ---------------------------------------------------------------- the driver's tables in these shapes: every turn, whole texts


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")


def _ordered(df: DataFrame, item) -> DataFrame:
    return df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"]).alias("x"))


def captions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _talk(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = F.struct((F.size("t") * 3.0).alias("duration"), F.transform("t", lambda s: F.array(s["turn"] * 3.0, s["turn"] * 3.0 + 2.5)).alias("timestamps"), F.transform("t", lambda s: s["text"]).alias("sentences"))
    return c.select(F.to_json(F.create_map(F.concat(F.lit("v"), "conv_id"), body)).alias("value"))


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.struct(F.when(F.col("role") == "user", F.col("text")).alias("query"), (F.col("turn") * 3.0).alias("clip_start_sec"), (F.col("turn") * 3.0 + 2.5).alias("clip_end_sec"))
    c = _ordered(_talk(spark, sf_dir), q)
    clip = F.struct(F.concat(F.lit("c"), "conv_id").alias("clip_uid"), F.array(F.struct(F.col("x").alias("language_queries"))).alias("annotations"))
    return c.select(F.col("conv_id").alias("doc"), F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("v"), "conv_id").alias("video_uid"), F.array(clip).alias("clips"))).alias("videos"))).alias("value"))


def choices_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _ordered(_talk(spark, sf_dir), F.col("text"))
    return c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit(" which one? ").alias("question"), F.col("x").alias("candidates"), (F.col("conv_id") % F.size("x")).cast("int").alias("correct_choice"))).alias("value"))


def srt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), F.format_string("00:00:%02d,000 --> 00:00:%02d,500", F.col("turn") * 3, F.col("turn") * 3 + 2), F.lit("\n<i>"), F.regexp_replace("text", "\\s+", " "), F.lit("</i>"))
    return _ordered(_talk(spark, sf_dir), line).select(F.col("conv_id").alias("video_id"), F.array_join("x", "\n\n").alias("value"))


def subtitle_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.struct((F.col("turn") * 3.0).cast("string").alias("start"), F.format_string("00:00:%02d,500", F.col("turn") * 3 + 2).alias("end"), F.col("text").alias("line"))
    return _ordered(_talk(spark, sf_dir), x).select(F.col("conv_id").alias("video_id"), F.to_json("x").alias("value"))
