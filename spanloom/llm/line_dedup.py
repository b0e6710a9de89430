"""Line dedup: overlapping windows of three lines, DataFrame functions only.

The lines of a text that hold more than white space are numbered; each run of three neighbours among them is a window, known by 128 bits of hash
of its trimmed lines.  A window that also starts earlier in the corpus (smaller document, or same document and earlier line) is a later
occurrence, and its three lines are removed; overlapping windows merge by covering positions.  Judged on the input, not on what is left.

Windows are counted by a partial aggregate, so a window in every document costs one row from each task; only windows that repeat are joined back, and
that join is one which AQE may split at a hot window.  Texts are shuffled once, to meet their removed lines.

Defined results: blank lines are never removed and don't part windows; a text with fewer than three lines that aren't blank is kept whole; null
text stays null with zero lines; rows with equal id and text are one document and get the same result; rows with equal id and other text are ordered by
their text's hash; a null id sorts first; an empty table gives an empty result; other columns pass through unless they are named like this operator's
(n_lines, n_removed, n_spans, kept_text; those are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE_CHARS

OWN = ("n_lines", "n_removed", "n_spans", "kept_text")


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines):
    """The positions of the lines that aren't blank."""
    numbered = F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(SPACE_CHARS)) != "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", window: int = 3) -> DataFrame:
    """The rows of docs with n_lines, n_removed, n_spans (runs of removed lines) and kept_text. See the module's text."""
    kept = [c for c in docs.columns if c.lower() not in OWN]
    # Columns that pass through travel in a struct, so that no name of theirs meets one that is used here.
    row = F.struct(*[F.col(f"`{c}`") for c in kept if c != "text"]).alias("row")
    base = docs.select(row, F.col("text").alias("text"), F.col(id_col).alias("id"), F.xxhash64("text").alias("th"))

    hashed = F.transform(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS))), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    part = lambda x, i, name: [F.get(x, i + k)[name] for k in range(window)]
    w = base.select(F.col("id").alias("_id"), F.col("th").alias("_th"), hashed.alias("_l")).where(F.size("_l") >= window)
    w = w.select("_id", "_th", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_l") - window), lambda i: F.struct(F.xxhash64(*part(F.col("_l"), i, "a")).alias("a"), F.xxhash64(*part(F.col("_l"), i, "b")).alias("b")))).alias("_at", "_w"))
    w = w.select("_id", "_th", "_at", F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"))
    first = w.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_th", "_at")).alias("_first"), F.max(F.struct("_id", "_th", "_at")).alias("_last")).where("_first <> _last").drop("_last")
    later = w.join(first, ["_a", "_b"]).where("NOT (struct(_id, _th, _at) <=> _first)")
    gone = later.groupBy("_id", "_th").agg(F.collect_set("_at").alias("_gone"))

    d = base.join(gone, base["id"].eqNullSafe(gone["_id"]) & (base["th"] == gone["_th"]), "left").select("row", "text", "_gone")
    d = d.withColumn("_lines", _lines(F.col("text"))).withColumn("_filled", _filled(F.col("_lines")))
    covered = F.array_distinct(F.flatten(F.transform("_gone", lambda p: F.transform(F.sequence(p, p + window - 1), lambda i: i))))
    d = d.withColumn("_covered", F.when(F.col("_gone").isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(covered)))
    d = d.withColumn("_removed", F.transform("_covered", lambda i: F.get(F.col("_filled"), i)))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    text = F.when(F.size("_covered") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    starts = F.size("_covered") - F.size(F.array_intersect("_covered", F.transform("_covered", lambda i: i + 1)))
    done = d.select(
        "row", "text",
        F.struct(
            F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.size("_covered").cast("long").alias("n_removed"), starts.cast("long").alias("n_spans"), text.alias("kept_text"),
        ).alias("own"),
    )
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in kept], *[F.col(f"own.{c}") for c in OWN])
