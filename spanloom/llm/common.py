"""Shared pieces of the corpus operators: the shared folder, flat text blocks, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: the space and 0x09 to 0x0D.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SPACE_CHARS = SPACES.decode()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

U64 = np.uint64
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spanloom-"))
    return _local[0]


class Scratch:
    """Tables written in the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, times: int = 1) -> None:
        """Let Spark remove the shuffle files of plans that are done; it does so once the driver collects its garbage (those of the last plan only at the second time)."""
        for _ in range(times):
            gc.collect()
            self.spark._jvm.System.gc()

    def drop(self, *numbers: int) -> None:
        """Remove tables that no later result reads; without numbers, all of them."""
        jvm = self.spark._jvm
        for path in [f"{self.at}/{n}" for n in numbers] or [self.at]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Column: the number of words of a text, 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- flat blocks of texts


def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts as one byte array and offsets; null texts are empty. A slice holds max_bytes or one row."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(texts))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one more entry at the end)."""
    inside = IS_WORD[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        inverse = pow(base, -1, 1 << 64)
        ups = np.full(size, U64(base), dtype=U64)
        downs = np.full(size, U64(inverse), dtype=U64)
        ups[0] = downs[0] = U64(1)
        got = np.cumprod(ups, dtype=U64), np.cumprod(downs, dtype=U64)
        if size <= 1 << 22:
            _powers[base] = got
    return got


class Rolling:
    """Hashes of any span of a byte array in constant time: prefix sums of b[i] * base**-i modulo 2**64."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASES[0]):
        self.up, down = _power(int(base), len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * down[: len(data)], out=self.prefix[1:])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[hi] - self.prefix[lo]) * self.up[lo] + (hi - lo).astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- connected components


#: Edges that one task contracts.
CONTRACT = 500_000


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that links between m nodes reach from each (minimum propagation with jumps)."""
    label = np.arange(m)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) as stars (node, least node) of each task's own components: at most one row for each node and task."""
    kind = edges.schema["u"].dataType.simpleString()

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            both = pa.concat_arrays([*t["u"].chunks, *t["v"].chunks])
            names = both.unique()
            names = names.take(pc.sort_indices(names))
            at = pc.index_in(both, names).to_numpy()
            root = roots(len(names), at[: t.num_rows], at[t.num_rows :])
            own = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(root[own]))], names=["u", "v"])

    return edges.select("u", "v").repartition(tasks).mapInArrow(contract, f"u {kind}, v {kind}")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each task first contracts its CONTRACT edges to stars.  If there is more than one, large-star and small-star steps (MapReduce connected components) alternate
    until nothing changes: each is a minimum by key, which is combined before the shuffle, and a join back, which AQE may split at hubs.
    """
    e = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    tasks = 1 + e.count() // CONTRACT
    e = scratch.keep(contracted(e, tasks))
    seen = None
    while tasks > 1:
        n = scratch.n
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.keep(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        scratch.drop(n)
        if tuple(now) == seen:
            break
        seen = tuple(now)
    centres = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
