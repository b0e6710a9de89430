"""Question answering: loaders' row shapes, result rows, accuracies, example choice. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

OPTION = r"\n\(([A-Z])\) "


def letter_match(predicted: Column, truth: Column, letters: str = "ABCD") -> Column:
    """Whether both answers have a letter, and the same."""
    return F.coalesce(T.standalone_letter(predicted, letters) == T.standalone_letter(truth, letters), F.lit(False))


def is_correct(row: dict[str, Column]) -> Column:
    """Of attached letters, if both are there; else of letters in the answers; else of the answers themselves."""
    parsed = T.standalone_letter(row["predicted"]) == T.standalone_letter(row["truth"])
    return F.coalesce(row["predicted_letter"] == row["truth_letter"], parsed, row["predicted"] == row["truth"], F.lit(False))


def result_rows(df: DataFrame, sample_id: Column, predicted: Column, truth: Column, is_choice: Column) -> DataFrame:
    """(sample_id, predicted, truth, predicted_letter, truth_letter, correct); only choices carry letters."""
    letters = {k: F.when(is_choice, T.standalone_letter(x)) for k, x in (("predicted_letter", predicted), ("truth_letter", truth))}
    d = df.select(sample_id.alias("sample_id"), predicted.alias("predicted"), truth.alias("truth"), *[x.alias(k) for k, x in letters.items()])
    return d.withColumn("correct", is_correct({c: F.col(c) for c in d.columns}))


def selection_rows(df: DataFrame, picked: Column, n: Column) -> DataFrame:
    """The rows of df with (state, score, reason): a picked chunk has score 1, no match and a failed parse have none and a reason."""
    state = F.when(picked.between(1, n), "selected").when(picked == 0, "no_match").otherwise("failed")
    d = df.withColumn("state", state)
    return d.withColumn("score", F.when(F.col("state") == "selected", 1.0)).withColumn("reason", F.when(F.col("state") == "no_match", "no matching chunk").when(F.col("state") == "failed", "no chunk number"))


def accuracy_by_tag(df: DataFrame, correct: str, tags: str) -> DataFrame:
    """(metric, value): in all, each row once, and for each tag of each row."""
    flat = df.select(F.col(correct).cast("int").alias("ok"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col(tags))).alias("tag"))
    name = F.when(F.col("tag").isNull(), "Accuracy").otherwise(F.concat(F.lit("Accuracy_"), T.slug(F.col("tag"))))
    return flat.groupBy(name.alias("metric")).agg(F.avg("ok").alias("value"))


def labelled(df: DataFrame, truth: str) -> DataFrame:
    """The rows whose truth isn't null or blank."""
    return df.where(F.trim(F.coalesce(F.col(truth).cast("string"), F.lit(""))) != "")


def accuracy_by_group(df: DataFrame, correct: str, groups: dict[str, str]) -> DataFrame:
    """(metric, value): in all and for each value that isn't blank of each column; groups: column -> prefix of the metric."""
    pairs = [F.struct(F.lit("Accuracy").alias("metric"))] + [F.struct(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(p), F.trim(F.col(c).cast("string")))).alias("metric")) for c, p in groups.items()]
    flat = df.select(F.col(correct).cast("int").alias("ok"), F.explode(F.array(*pairs)).alias("m")).where("m.metric IS NOT NULL")
    return flat.groupBy("m.metric").agg(F.avg("ok").alias("value"))


def exact_match(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(truth)).cast("int")).alias("accuracy"))


def question_and_options(raw: Column) -> tuple[Column, Column]:
    """The text before the first option, and the options that lines like "(A) …" begin."""
    parts = F.split(raw, OPTION)
    return F.trim(parts[0]), F.transform(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), lambda x: F.trim(x))


def answer_letter(candidates: Column, answer: Column) -> Column:
    """The letter of the first candidate that equals the answer but for outer space; null for none."""
    at = F.array_position(F.transform(candidates, lambda x: F.trim(x)), F.trim(answer))
    return F.when(at > 0, T.letter(at - 1))


def grouped_windows(df: DataFrame, keys: list[str], label: Column, position: str) -> DataFrame:
    """(keys, label, first_position, positions): windows of a label together, in order; labels lose quotes and underscores."""
    clean = F.trim(F.replace(F.replace(label, F.lit('"'), F.lit("")), F.lit("_"), F.lit(" ")))
    d = df.select(*keys, clean.alias("label"), F.col(position))
    return d.groupBy(*keys, "label").agg(F.min(position).alias("first_position"), F.array_sort(F.collect_list(position)).alias("positions"))


def two_kinds(a: DataFrame, b: DataFrame, prefixes: tuple[str, str]) -> DataFrame:
    """The rows of two tables (id, text, …) with ids that tell their kind; columns that one lacks are null."""
    return a.withColumn("id", F.concat(F.lit(prefixes[0]), "id")).unionByName(b.withColumn("id", F.concat(F.lit(prefixes[1]), "id")), allowMissingColumns=True)


def surviving(queries: DataFrame, gallery: DataFrame, target: str) -> DataFrame:
    """queries with (skipped): whether their target is missing from the gallery. One join tells both."""
    there = gallery.select(target).distinct().withColumn("_there", F.lit(True))
    return queries.join(there, target, "left").withColumn("skipped", F.col("_there").isNull()).drop("_there")


def alternating(df: DataFrame, flag: str, order: list[str], n: int) -> DataFrame:
    """n rows in turn with and without the flag; when one kind is used up, the other goes on."""
    turn = F.row_number().over(Window.partitionBy(flag).orderBy(*order))
    few = df.withColumn("_turn", turn).where(F.col("_turn") <= n)
    return few.orderBy("_turn", F.desc(flag), *order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_turn", F.desc(flag), *order))).drop("_turn")


def transcript(df: DataFrame, key: str, start: str, text: str, offset: float = 0.0, stamps: bool = False) -> DataFrame:
    """(key, transcript): a video's subtitles in order of time, a line each."""
    line = F.concat(F.lit("["), T.clock(F.col(start) + offset), F.lit("] "), F.col(text)) if stamps else F.col(text)
    d = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), line.alias("line")))).alias("l"))
    return d.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def inferred_duration(known: Column, metadata: Column, last: Column) -> Column:
    """A video's duration, else that of its metadata, else 1.05 times the last time, else 100."""
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(known), positive(metadata), positive(last * F.lit(1.05)), F.lit(100.0))


def highlights(clips: DataFrame, saliency: DataFrame, thresholds: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(threshold, hit1, map): of scored clips (query_id, clip, score) against saliency (query_id, annotator, clip, saliency).

    Hit: whether any annotator finds the best clip (the first on ties) salient; map: mean average precision over queries and annotators. Clips without a label aren't salient;
    queries without labels don't count.
    """
    raters = saliency.select("query_id", "annotator").distinct()
    level = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    d = clips.join(raters, "query_id").select("*", level).join(saliency, ["query_id", "annotator", "clip"], "left")
    key = ["threshold", "query_id", "annotator"]
    d = d.select(*key, "clip", "score", F.coalesce((F.col("saliency") >= F.col("threshold")).cast("int"), F.lit(0)).alias("y"))
    down = Window.partitionBy(*key).orderBy(F.desc("score"), "clip")
    up = Window.partitionBy(*key).orderBy("score", F.desc("clip")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("n", F.row_number().over(down)).withColumn("p", F.sum("y").over(down.rowsBetween(Window.unboundedPreceding, 0)) / F.col("n"))
    d = d.withColumn("e", F.max("p").over(up))  # the best precision from here on down, read upward
    each = d.groupBy(*key).agg(F.when(F.sum("y") > 0, F.sum(F.col("y") * F.col("e")) / F.sum("y")).otherwise(0.0).alias("ap"), F.max(F.when(F.col("n") == 1, F.col("y"))).alias("top"))
    hits = each.groupBy("threshold", "query_id").agg(F.max("top").alias("hit")).groupBy("threshold").agg(F.avg("hit").alias("hit1"))
    return hits.join(each.groupBy("threshold").agg(F.avg("ap").alias("map")), "threshold")
