"""Mixing sources to target weights: a time-varying curriculum.

Sources share ``budget`` times all words by weight, but none more than ``repeats`` times its own words (water filling).
A schedule says how a source's share of attention moves over training time from 0 to 1: the linear weight
``start + (end - start) * t``.  Its integral, normalised to the source's target, is the source's cumulative token demand; a copy of a
document that begins at token c of its source's stream stands where that demand reaches c (the integral inverted).  Copies are
then range-sorted by position.

Prefix sums over a source run in two levels: md5 prefixes deal a source's documents into ``16 ** digits`` buckets, sums of buckets
are accumulated per source, and documents within their bucket; so a hot source is spread over many tasks.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, ordered last;
rows that repeat a doc_id are mixed one by one; an empty table gives an empty result; other columns are not read.
The copy that meets the target is cut at its ``take_words`` first words, so that a source's words add up to its target (rounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Attention at the start and the end of training, by the rank of a source (repeating): early, late, even.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size); one row for each source.

    The level L of min(cap, weight * L) is that of the first source, by cap / weight, which the rest of the budget doesn't fill; from there on levels only fall.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(w, F.col("rank") % len(weights) + 1)).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    by_fill = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("total", F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(budget) * F.col("total") - before) / after)
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return s.select("source", "source_size", "rank", target.alias("target"))


def position(c, target, start, end):
    """Column: the time at which a demand of ``target`` tokens under the weight start + (end - start) * t reaches c."""
    mean, half = (start + end) / 2, (end - start) / 2
    u = c / target * mean  # start * t + half * t * t = u
    root = F.sqrt(F.greatest(start * start + half * 4 * u, F.lit(0.0)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * u / (start + root)))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = 1.5, repeats: int = 2, digits: int = 3, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: id_col, size, source, source_size, target, taken, copies array<struct<copy, take_words, position>>, and the columns in keep."""
    d = docs.select(id_col, "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_h"), *keep)
    d = d.withColumn("_b", F.substr("_h", F.lit(1), F.lit(digits)))
    buckets = d.groupBy("source", "_b").agg(F.sum("size").alias("_in"))
    t = targets(buckets.groupBy("source").agg(F.sum("_in").alias("source_size")), weights, budget, repeats)
    in_order = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_base", F.coalesce(F.sum("_in").over(in_order), F.lit(0)))
    plan = buckets.join(t, buckets["source"].eqNullSafe(t["source"])).select(buckets["source"].alias("_s"), F.col("_b").alias("_k"), "_base", "source_size", "rank", "target")
    within = Window.partitionBy("source", "_b").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(plan, d["source"].eqNullSafe(plan["_s"]) & (d["_b"] == plan["_k"]))
    words = F.round("target").cast("long")
    d = d.withColumn("_c", F.col("_base") + F.col("_before")).withColumn("_words", words)
    pick = lambda side: F.element_at(F.array(*[F.lit(float(x[side])) for x in schedules]), F.col("rank") % len(schedules) + 1)
    copies = F.array(*[
        F.struct(
            F.lit(k).alias("copy"),
            F.greatest(F.lit(0).cast("long"), F.least("size", F.col("_words") - F.col("source_size") * k - F.col("_c"))).alias("take_words"),
            position(F.col("_c") + F.col("source_size") * k, F.greatest(F.col("target"), F.lit(1.0)), pick(0), pick(1)).alias("position"),
        )
        for k in range(repeats)
    ])
    d = d.withColumn("copies", F.filter(copies, lambda x: x["take_words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["take_words"])
    return d.select(id_col, "size", "source", "source_size", "target", taken.alias("taken"), "copies", *keep)


def training_order(mixed: DataFrame, untaken: bool = False) -> DataFrame:
    """One row for each copy that the mix takes, range-sorted by training position (ties by id and copy); untaken: then one for each document that it takes nothing from, without copy."""
    each = F.explode_outer("copies") if untaken else F.explode("copies")
    flat = mixed.select("*", each.alias("_copy")).drop("copies")
    flat = flat.select("*", "_copy.copy", "_copy.take_words", "_copy.position").drop("_copy")
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position").asc_nulls_last(), F.col(mixed.columns[0]), F.col("copy")]  # ids deal the untaken over many ranges
    return flat.repartitionByRange(n, *order).sortWithinPartitions(*order)
