"""Run folders: numbered names, results written once and read again, on any file system that Spark reaches."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def next_number(spark: SparkSession, folder: str) -> int:
    """One more than the largest number that a run in the folder starts with; 1 in an empty or missing folder."""
    fs, p = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return 1 + max((int(m.group(1)) for m in (re.match(r"(\d+)-", n) for n in names) if m), default=0)


def new_run(spark: SparkSession, out: str, task: str, dataset: str, notes: str = "") -> str:
    """Makes {out}/{task}/{dataset}/{number}-{notes}-{eight letters of a random id}; notes keep letters, digits and _, 40 at most."""
    folder = f"{out.rstrip('/')}/{task}/{dataset}"
    words = re.sub(r"[^A-Za-z0-9]+", "_", notes).strip("_")[:40]
    path = f"{folder}/{'-'.join(x for x in (str(next_number(spark, folder)), words, uuid.uuid4().hex[:8]) if x)}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    return path


def save(df: DataFrame, run: str, name: str) -> None:
    """Writes a table of the run beside its place, then renames it there, so a reader sees all of it or nothing; an older one is replaced."""
    spark, part = df.sparkSession, f"{run}/.{name}-{uuid.uuid4().hex}"
    df.write.parquet(part)
    fs, source = _fs(spark, part)
    target = _fs(spark, f"{run}/{name}")[1]
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"can't rename {part}")


def save_settings(spark: SparkSession, run: str, settings: dict) -> None:
    fs, p = _fs(spark, f"{run}/settings.json")
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(settings, sort_keys=True).encode()))
    finally:
        out.close()


def load(spark: SparkSession, run: str) -> tuple[dict, dict[str, DataFrame]]:
    """The settings of a run ({} without) and its tables by name; parts of unfinished writes aren't read."""
    fs, p = _fs(spark, run)
    names = {s.getPath().getName() for s in fs.listStatus(p)}
    settings = json.loads(spark.read.option("wholetext", True).text(f"{run}/settings.json").first()[0]) if "settings.json" in names else {}
    return settings, {n: spark.read.parquet(f"{run}/{n}") for n in sorted(names) if n != "settings.json" and not n.startswith(".")}


def unfinished(asked: DataFrame, done: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """Rows of asked whose key isn't done; with failed, the failed ones again too."""
    left = asked.join(done.select(key).distinct(), key, "left_anti")
    if failed is None:
        return left
    return left.unionByName(asked.join(failed.select(key).distinct(), key, "left_semi")).dropDuplicates([key])
