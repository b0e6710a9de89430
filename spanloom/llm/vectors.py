"""Embedding near-dedup on a robust-pruned flat graph, built on overlapping cluster shards.

1. Equal vectors of a label are one class, stood for by its smallest id (an aggregate, combined before its shuffle): a thousand copies cost one node.
2. Centres are fitted per label on a bounded sample (``SAMPLE`` vectors in all, ``CENTRES`` centres in all). Centres that are nearer to each other than two linked vectors may be are one shard, so that a group of near copies isn't split.
   A class goes to its nearest centre and to every centre that the midpoint of a link from it may be nearest to: with home h and centre i, if (h - i) . v <= |h - i| * half the greatest length of a link.
   Both ends of a link so meet in the shard of its midpoint, whatever the centres are: no link is lost between shards.
   A shard over ``LIMIT`` is dealt on into blocks, and each pair of blocks becomes a shard: the exact way for clusters that don't split. The number of centres is the one that makes the least work (see ``fitted``).
3. In each shard every node keeps at most ``DEGREE`` neighbours by robust pruning (a candidate goes if a kept one is nearer to it, by ALPHA), of its nearest and some
   random candidates, and backward edges.
4. Each node of a shard is sought from the shard's medoid and from its own place: best first over ``BEAM`` expansions, then on through all nodes in range. What is found is verified by
   its cosine in double precision. A pair that several shards hold counts in one (the least shard they share); so no pair leaves its task, only counts and spanning links.
5. Components of the links, counts of links.

``audit`` measures recall: every ``BY``-th id against all rows, by brute force in blocks.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, has no links, is its own component and is kept;
vectors of different length don't link; rows that share an id are one node of the components, each row counts as a vector; a null id is never in a component (null, kept); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, components, roots

SAMPLE, CENTRES, SHARD, LIMIT = 20_000, 4096, 2048, 4096
DEGREE, NEAREST, RANDOM, ALPHA = 24, 40, 24, 1.15
BEAM, AT_ONCE, SLACK, BATCH = 32, 8, 0.04, 256
#: Vectors of a label's sample by which a number of centres is judged.
TRIED = 1000
BY = 50


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def centres(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centres by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(4):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def merged(c: np.ndarray, length: float) -> np.ndarray:
    """For each centre the least one that it is joined to by steps shorter than length."""
    root, size = np.arange(len(c)), (c * c).sum(axis=1)
    for lo in range(0, len(c), 256):
        a, b = np.nonzero(size[lo : lo + 256, None] + size - 2 * c[lo : lo + 256] @ c.T < length * length)
        root = roots(len(c), np.concatenate((a + lo, np.arange(len(c)))), np.concatenate((b, root)))
    return root


def shards_of(v: np.ndarray, c: np.ndarray, root: np.ndarray, length: float) -> list[list[int]]:
    """The shards of unit vectors: two that are at most length apart share one, that of the centre nearest to their midpoint."""
    out, size = [], (c * c).sum(axis=1)
    for lo in range(0, len(v), 512):
        sims = v[lo : lo + 512] @ c.T
        home = sims.argmax(axis=1)
        apart = np.sqrt(np.maximum(0, size[home, None] + size - 2 * c[home] @ c.T))
        for row in sims.max(axis=1)[:, None] - sims <= apart * (length / 2) + 1e-9:
            out.append(np.unique(root[row]).tolist())
    return out


def fitted(sample: np.ndarray, n: int, most: int, length: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their shards' roots for n vectors, of which sample is a sample: of most centres, half of them and so on down to one, those whose shards make the least work.

    Shards overlap, since both ends of every link meet; where vectors hardly part, many overlapping shards are more work than few. The work is the sum of squared shard sizes, as projected from ``TRIED`` of the sample.
    """
    best, tried = None, sample[np.random.default_rng(seed).permutation(len(sample))[:TRIED]]
    while True:
        c = centres(sample, most)
        root = merged(c, length)
        share = np.bincount([r for held in shards_of(tried, c, root, length) for r in held], minlength=len(c)) / len(tried)
        blocks = np.maximum(1, np.ceil(share * n / LIMIT))
        work = float(((share * n) ** 2 * np.where(blocks > 1, 2 * (blocks - 1) / blocks, 1)).sum())  # a pair of blocks is a shard
        if best is None or work <= best[0]:
            best = work, c, root
        if most == 1:
            return best[1:]
        most = -(-most // 2)


def pruned(node: int, candidates: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and drops those that it is nearer to, by ALPHA, than the node is."""
    to = 1 - v[candidates] @ v[node]
    order = np.argsort(to, kind="stable")
    candidates, to = candidates[order], to[order]
    apart = 1 - v[candidates] @ v[candidates].T
    alive, kept = np.ones(len(candidates), dtype=bool), []
    for k in range(len(candidates)):
        if alive[k]:
            kept.append(k)
            if len(kept) == DEGREE:
                break
            alive &= ALPHA * apart[k] > to
    return candidates[kept]


def graph(v: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors, with backward edges."""
    m, rng = len(v), np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for lo in range(0, m, 512):
        near = v[lo : lo + 512] @ v.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -2
        k = min(NEAREST, m - 1)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(near), 0), np.int64)
        for i in range(len(near)):
            c = np.unique(np.concatenate((top[i], rng.integers(0, m, RANDOM))))
            out.append(pruned(lo + i, c[c != lo + i], v))
    back: list[list[int]] = [[] for _ in range(m)]
    for i, n in enumerate(out):
        for j in n:
            back[j].append(i)
    # A hub keeps the first of its backward edges; the others hang on those as a tree, so that no node is out of reach.
    most = 2 * DEGREE
    tree: list[list[int]] = [[] for _ in range(m)]
    for b in back:
        for j in range(most, len(b)):
            tree[b[j // most - 1]].append(b[j])
    return [np.unique(np.concatenate((n, np.array(b[:most] + t, np.int64)))) if b or t else n for n, b, t in zip(out, back, tree, strict=True)]


def padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max(1, max((len(x) for x in lists), default=1))), -1, dtype=np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def found(v: np.ndarray, near: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, rows in range) of a greedy search from the medoid and its own node that expands its range; each row of v is a query."""
    m = len(v)
    mean = v.mean(axis=0)
    start = int((v @ mean).argmax())
    for lo in range(0, m, BATCH):
        q = np.arange(lo, min(lo + BATCH, m))
        rows = np.arange(len(q))
        sims = np.full((len(q), m), -np.inf)  # of rows that have been visited
        left = np.full((len(q), m), -np.inf)  # of those that may still be expanded
        seen = np.zeros((len(q), m + 1), dtype=bool)  # the last column is that of padding
        sims[:, start] = left[:, start] = v[q] @ v[start]
        sims[rows, q] = left[rows, q] = 1.0  # a query is a node itself; among far vectors the walk alone may not come near it
        for turn in range(10 * m):
            if turn * AT_ONCE < BEAM:
                top = np.argpartition(-left, min(m, AT_ONCE) - 1, axis=1)[:, : min(m, AT_ONCE)]
                r, c = np.nonzero(np.take_along_axis(left, top, axis=1) > -np.inf)
                at = top[r, c]
            else:  # the range grows by all its new nodes; what it is in the end doesn't depend on their order
                r, at = np.nonzero(left >= threshold - SLACK)
            if not len(r):
                break
            left[r, at] = -np.inf
            for a in range(0, len(r), 1 << 15):
                n = near[at[a : a + (1 << 15)]]
                seen[np.repeat(r[a : a + (1 << 15)], n.shape[1]), n.ravel()] = True
            seen[:, :m] &= sims == -np.inf
            r, n = np.nonzero(seen[:, :m])
            seen[:] = False
            for a in range(0, len(r), 1 << 15):
                rr, nn = r[a : a + (1 << 15)], n[a : a + (1 << 15)]
                s = np.einsum("ij,ij->i", v[q[rr]], v[nn])
                sims[rr, nn] = s
                left[rr, nn] = s
        r, n = np.nonzero(sims >= threshold - 1e-9)
        yield q[r], n


def usable(df: DataFrame, vec_col: str, label_col: str):
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False))


def classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Every row with its class: (id, label, dim, h1, h2, ok, vec)."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    return df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vec"), (usable(df, vec_col, label_col) & F.col(id_col).isNotNull()).alias("ok")).select("id", "label", "ok", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"), "vec")


def near_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row. See the module's text."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = classes(df, id_col, vec_col, label_col)
    node = rows.where("ok").groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.first("vec").alias("vec"))
    node = scratch.keep(node)
    id_kind, label_kind = node.schema["rep"].dataType.simpleString(), node.schema["label"].dataType.simpleString()
    sizes = node.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = max(1, node.count())
    share = sizes.withColumn("k", F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / SHARD), F.ceil(F.col("n") * CENTRES / F.lit(total)))).cast("int"))
    picked = node.join(share.where("k > 1").select("label", "dim", "k", "n"), ["label", "dim"]).orderBy(F.xxhash64("h1", "h2"), "h1").limit(SAMPLE).select("label", "dim", "k", "n", "vec")
    by_label: dict = {}
    for r in picked.collect():  # SAMPLE at most
        by_label.setdefault((r.label, r.dim), (r.k, r.n, []))[2].append(r.vec)
    length = float(np.sqrt(max(0.0, 2 - 2 * (threshold - 1e-9))))
    known = spark.sparkContext.broadcast({key: fitted(unit(np.array(v)), n, min(k, len(v)), length) for key, (k, n, v) in by_label.items()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            shards: list = [[0]] * batch.num_rows
            for key in set(zip(label, dim, strict=True)) & set(known.value):
                at = [k for k, x in enumerate(zip(label, dim, strict=True)) if x == key]
                for k, held in zip(at, shards_of(unit(matrix(batch.column("vec").take(pa.array(at)))), *known.value[key], length), strict=True):
                    shards[k] = held
            yield batch.select(["label", "dim", "rep", "c", "vec"]).append_column("shards", pa.array(shards, pa.list_(pa.int64())))

    dealt = node.select("label", "dim", "rep", "c", "vec").mapInArrow(deal, f"label {label_kind}, dim int, rep {id_kind}, c long, vec array<double>, shards array<long>")
    flat = dealt.select("label", "dim", "rep", "c", "vec", "shards", F.explode("shards").alias("cluster"))
    large = flat.groupBy("label", "dim", "cluster").agg(F.ceil(F.count("*") / LIMIT).cast("int").alias("blocks"))
    flat = flat.join(large, ["label", "dim", "cluster"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda j: (j != own) | (F.col("blocks") == 1)), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    flat = flat.select("label", "dim", "rep", "c", "vec", "shards", "cluster", "blocks", own.alias("own"), F.explode(pairs).alias("pair"))

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep = t["rep"].combine_chunks()
        raw, c = matrix(t["vec"]), t["c"].to_numpy()
        m, v = len(raw), unit(raw)
        near = padded(graph(v) if m > 1 else [np.zeros(0, np.int64)])
        held, cluster, own = t["shards"].to_pylist(), t["cluster"][0].as_py(), t["own"].to_numpy()
        blocks = t["blocks"][0].as_py()
        first, second = divmod(t["pair"][0].as_py(), blocks)
        whole = [k for k in (first, second) if {k, (k + 1) % blocks} == {first, second}]  # links inside of block k count where it meets the next
        long = max(len(x) for x in held)
        member = np.array([x + [-1 - k] * (long - len(x)) for k, x in enumerate(held)])
        scale = np.abs(raw).max(axis=1)
        exact = raw / scale[:, None]
        norm = np.sqrt((exact * exact).sum(axis=1))
        linked = np.zeros((m, m), dtype=bool)
        for a, b in found(v, near, threshold):
            for z in range(0, len(a), 1 << 18):
                x, y = a[z : z + (1 << 18)], b[z : z + (1 << 18)]
                s = np.einsum("ij,ij->i", exact[x], exact[y]) / (norm[x] * norm[y])
                good = (s >= threshold) & (x != y)
                linked[np.minimum(x, y)[good], np.maximum(x, y)[good]] = True
        n, root = np.zeros(m, dtype=np.int64), np.arange(m)
        for lo in range(0, m, 64):
            a, b = np.nonzero(linked[lo : lo + 64])
            a += lo
            if not len(a):
                continue
            mine = (own[a] != own[b]) | np.isin(own[a], whole)
            for k in range(long):  # the least cluster that both hold
                x = member[a, k]
                lower = (x < cluster) & (x >= 0)
                if lower.any():
                    mine[lower] &= ~(member[b[lower]] == x[lower, None]).any(axis=1)
            n += np.bincount(a[mine], c[b[mine]], m).astype(np.int64) + np.bincount(b[mine], c[a[mine]], m).astype(np.int64)
            root = roots(m, np.concatenate((a, np.arange(m))), np.concatenate((b, root)))
        return pa.table([t["label"].combine_chunks(), rep, pa.array(n), rep.take(pa.array(root))], names=["label", "rep", "n", "root"])

    out = scratch.keep(flat.groupBy("label", "dim", "cluster", "pair").applyInArrow(search, f"label {label_kind}, rep {id_kind}, n long, root {id_kind}"))
    links = out.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # Rows that share an id stand for one node: their classes meet.
    comp = components(links, scratch)
    n_links = out.join(node.select("label", "rep").distinct(), ["label", "rep"]).groupBy("label", "rep").agg(F.sum("n").alias("n"))
    of = node.join(n_links, ["label", "rep"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("label", "dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    of = of.withColumnsRenamed({"label": "_l", "dim": "_d", "h1": "_1", "h2": "_2"})
    all_rows = rows.drop("vec").join(of, F.col("ok") & (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    got = all_rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def audit(df: DataFrame, result: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", by: int = BY) -> DataFrame:
    """(found, there, recall) over the links of every by-th id: what result has, and what brute force finds in blocks of all rows."""
    rows = classes(df, id_col, vec_col, label_col).where("ok")
    asked = rows.where(F.col("id") % by == 0)
    dot = F.aggregate(F.zip_with(F.col("q.vec"), F.col("r.vec"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    pairs = asked.alias("q").join(rows.alias("r"), (F.col("q.label") == F.col("r.label")) & (F.col("q.dim") == F.col("r.dim")) & (F.col("q.id") != F.col("r.id")))
    there = pairs.where(dot / (size(F.col("q.vec")) * size(F.col("r.vec"))) >= threshold).groupBy(F.col("q.id").alias("_q")).agg(F.count("*").alias("there"))
    got = result.where(F.col(id_col) % by == 0).join(there, F.col(id_col) == F.col("_q"), "left")
    return got.agg(F.sum("n_links").alias("found"), F.sum(F.coalesce("there", F.lit(0))).alias("there")).withColumn("recall", F.when(F.col("there") > 0, F.col("found") / F.col("there")).otherwise(1.0))
