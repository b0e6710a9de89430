"""Evaluation metrics as aggregations. Predictions are (query_id, rank, start, end, score), truths (query_id, gt_idx, start, end)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(ps: Column, pe: Column, gs: Column, ge: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(pe, ge) - F.greatest(ps, gs))
    union = (pe - ps) + (ge - gs) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlaps(preds: DataFrame, gts: DataFrame) -> DataFrame:
    """(query_id, rank, gt_idx, iou) of every prediction with each truth of its query."""
    p, g = preds.alias("p"), gts.alias("g")
    value = iou(F.col("p.start"), F.col("p.end"), F.col("g.start"), F.col("g.end"))
    return p.join(g, "query_id").select("query_id", "rank", "gt_idx", value.alias("iou"))


def best_iou(preds: DataFrame, gts: DataFrame) -> DataFrame:
    return overlaps(preds, gts).groupBy("query_id", "rank").agg(F.max("iou").alias("iou"))


def recall_at(preds: DataFrame, gts: DataFrame, ks: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """(k, threshold, recall): the share of queries with a hit among their first k. Every query with a truth counts."""
    grid = [F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k in ks for t in thresholds]
    b = best_iou(preds, gts)
    hits = b.select("query_id", "rank", "iou", F.explode(F.array(*grid)).alias("g")).select("query_id", "rank", "iou", "g.k", "g.threshold").groupBy("query_id", "k", "threshold").agg(F.max(((F.col("rank") <= F.col("k")) & (F.col("iou") >= F.col("threshold"))).cast("int")).alias("hit"))
    every = gts.select("query_id").distinct().select("query_id", F.explode(F.array(*grid)).alias("g")).select("query_id", "g.k", "g.threshold")
    return every.join(hits, ["query_id", "k", "threshold"], "left").groupBy("k", "threshold").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def average_precision(preds: DataFrame, gts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(query_id, threshold, ap). A prediction claims its single best truth; it is right if that is good enough and wasn't claimed by an earlier right one."""
    best = overlaps(preds, gts).groupBy("query_id", "rank").agg(F.max(F.struct("iou", (-F.col("gt_idx")).alias("neg"))).alias("b")).select("query_id", "rank", "b.iou", (-F.col("b.neg")).alias("gt_idx"))
    d = best.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    d = d.withColumn("ok", (F.col("iou") >= F.col("threshold")) & (F.col("iou") > 0))
    claim = Window.partitionBy("query_id", "threshold", "gt_idx", "ok").orderBy("rank")
    d = d.withColumn("tp", (F.col("ok") & (F.row_number().over(claim) == 1)).cast("int"))
    d = d.join(gts.groupBy("query_id").agg(F.count("*").alias("n_gt")), "query_id")
    run = Window.partitionBy("query_id", "threshold").orderBy("rank")
    d = d.withColumn("n", F.row_number().over(run)).withColumn("precision", F.sum("tp").over(run) / F.col("n"))
    d = d.withColumn("envelope", F.max("precision").over(run.rowsBetween(0, Window.unboundedFollowing)))
    got = d.groupBy("query_id", "threshold").agg(F.sum(F.col("tp") / F.col("n_gt") * F.col("envelope")).alias("ap"))
    every = gts.select("query_id").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return every.join(got, ["query_id", "threshold"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def mean_average_precision(preds: DataFrame, gts: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    return average_precision(preds, gts, thresholds).groupBy("threshold").agg(F.avg("ap").alias("map"))


def mean_iou(preds: DataFrame, gts: DataFrame) -> DataFrame:
    top = best_iou(preds.where("rank = 1"), gts)
    return gts.select("query_id").distinct().join(top, "query_id", "left").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("miou"))


def binary_ap(df: DataFrame, key: str, score: str, label: str, order: str) -> DataFrame:
    """(key, ap) of labels sorted by score; 0 without positives."""
    run = Window.partitionBy(key).orderBy(F.desc(score), order)
    d = df.withColumn("_n", F.row_number().over(run)).withColumn("_tp", F.sum(label).over(run)).withColumn("_p", F.col("_tp") / F.col("_n"))
    d = d.withColumn("_e", F.max("_p").over(run.rowsBetween(0, Window.unboundedFollowing)))
    return d.groupBy(key).agg(F.when(F.sum(label) > 0, F.sum(F.col(label) * F.col("_e")) / F.sum(label)).otherwise(0.0).alias("ap"))


def clip_scores(preds: DataFrame, durations: DataFrame, length: float = 2.0) -> DataFrame:
    """(query_id, clip, score): for each clip the greatest prediction score times covered share, scaled to 0..1 if not all are equal."""
    n = F.greatest(F.lit(1), (F.col("duration") / length).cast("int"))
    clips = durations.select("query_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("clip"))
    j = clips.join(preds, "query_id", "left")
    cover = F.greatest(F.lit(0.0), F.least(F.col("end"), (F.col("clip") + 1) * F.lit(length)) - F.greatest(F.col("start"), F.col("clip") * F.lit(length))) / length
    s = j.groupBy("query_id", "clip").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("score") * cover), F.lit(0.0))).alias("score"))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return s.withColumn("score", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.col("score")))


def accuracy_breakdown(df: DataFrame, correct: str, categories: list[str]) -> DataFrame:
    """(category, value, n, accuracy): in all, and for each value that isn't blank of each category; one pass by grouping sets."""
    pairs = [F.struct(F.lit("all").alias("category"), F.lit("all").alias("value"))] + [F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in categories]
    d = df.select(F.col(correct).cast("int").alias("_ok"), F.explode(F.array(*pairs)).alias("c")).where(F.coalesce(F.trim("c.value"), F.lit("")) != "")
    return d.groupBy("c.category", "c.value").agg(F.count("*").alias("n"), F.avg("_ok").alias("accuracy"))


def macro_accuracy(df: DataFrame, correct: str, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.avg(F.col(correct).cast("int")).alias("a"), F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("s")).agg(F.avg("a").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def pass_at(ranks: DataFrame, targets: DataFrame, ks: tuple[int, ...], item: str) -> DataFrame:
    """(k, pass_rate): the share of queries whose target is among their first k. ranks: (query_id, item, rank)."""
    t = targets.withColumnRenamed("target", item)
    hit = t.join(ranks, ["query_id", item], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return hit.groupBy("k").agg(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("int"), F.lit(0))).alias("pass_rate"))


def matched(truths: np.ndarray, found: np.ndarray, reach: float) -> int:
    """Truths in order take the nearest detection that is left, if it is within reach."""
    left, hits = list(found), 0
    for t in truths:
        if not left:
            break
        k = int(np.argmin([abs(x - t) for x in left]))
        if abs(left[k] - t) <= reach:
            hits += 1
            left.pop(k)
    return hits


def boundary_f1(truths: DataFrame, found: DataFrame, durations: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, precision, recall, f1): per video the rater of the greatest F1 (the first on ties), summed over videos. truths: (video_id, rater, t), found: (video_id, t)."""
    t = truths.groupBy("video_id", "rater").agg(F.sort_array(F.collect_list("t")).alias("gt"))
    d = found.groupBy("video_id").agg(F.sort_array(F.collect_list("t")).alias("det"))
    j = t.join(d, "video_id", "left").join(durations, "video_id")

    def count(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                det = np.array([]) if r.det is None else np.asarray(r.det)
                for th in thresholds:
                    rows.append((r.video_id, r.rater, th, matched(np.asarray(r.gt), det, th * r.duration), len(r.gt), len(det)))
            yield pd.DataFrame(rows, columns=["video_id", "rater", "threshold", "tp", "pos", "det"])

    v, k = (truths.schema[c].dataType.simpleString() for c in ("video_id", "rater"))
    n = j.mapInPandas(count, f"video_id {v}, rater {k}, threshold double, tp int, pos int, det int")
    best = Window.partitionBy("video_id", "threshold").orderBy(F.desc(F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("pos") + F.col("det"))).otherwise(0.0)), "rater")
    s = n.withColumn("_r", F.row_number().over(best)).where("_r = 1").groupBy("threshold").agg(F.sum("tp").alias("tp"), F.sum("pos").alias("pos"), F.sum("det").alias("det"))
    p, r = F.when(F.col("det") > 0, F.col("tp") / F.col("det")).otherwise(0.0), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    return s.select("threshold", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def wups(pairs: DataFrame, similarity: DataFrame | None, gamma: float = 0.9) -> DataFrame:
    """(id, wups) of (id, answer, truth) token arrays and a table (a, b, sim) of word similarities, both ways; those under gamma count a tenth. Without a table only equal words are similar, and rows stay where they are.

    A word's other similarities come by its neighbours in the table that the other side holds; pairs of words aren't listed.
    """
    got = pairs
    if similarity is not None:
        sim = similarity.where("a <> b").groupBy("a", "b").agg(F.max(F.when(F.col("sim") < gamma, F.col("sim") * 0.1).otherwise(F.col("sim"))).alias("sim")).where("sim > 0")

        def near(x: str, y: str, name: str) -> DataFrame:
            asked = pairs.select("id", F.explode(F.array_distinct(x)).alias("a")).join(sim, "a")
            best = asked.join(pairs.select("id", F.explode(F.array_distinct(y)).alias("b")), ["id", "b"], "left_semi").groupBy("id", "a").agg(F.max("sim").alias("sim"))
            return best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("a", "sim"))).alias(name))

        got = pairs.join(near("answer", "truth", "_x"), "id", "left").join(near("truth", "answer", "_y"), "id", "left")

    def side(x: str, y: str, best: str) -> Column:
        if similarity is None:
            return F.when((F.size(x) > 0) & (F.size(y) > 0), (F.size(F.array_except(x, y)) == 0).cast("double"))
        other = lambda a: F.coalesce(F.try_element_at(best, a), F.lit(0.0))
        each = lambda a: F.greatest(other(a), F.when(F.array_contains(y, a), 1.0).otherwise(0.0))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.aggregate(x, F.lit(1.0), lambda s, a: s * each(a)))

    least = F.least(side("answer", "truth", "_x"), side("truth", "answer", "_y"))
    return got.select("id", F.when(F.array_sort("answer") == F.array_sort("truth"), 1.0).otherwise(F.coalesce(least, F.lit(0.0))).alias("wups"))
