"""MinHash near-dedup: a chosen-path set similarity join.

Texts become sets of 5-word shingles; equal sets are one class from here on, stood for by its smallest id.  Each of ``TREES`` independent trees branches
its documents by selected minwise tokens: in a node, hash function j is selected with probability 1 / (similarity * K) by the node's own seed, and a
document goes to the child (j, its minimum under j).  A pair of similarity s so shares s / similarity children of a node on average: one or more if the pair is
to be found.  A node with one document ends; a node of at most ``SMALL`` documents is compared exhaustively; a larger one branches again, down to ``DEPTH``.

Comparison of nodes doesn't emit all pairs of a group.  In a round every document meets one pivot, that of the largest of its nodes that has one it isn't connected with; so a
round makes one pair for each document at most.  The first rounds read only ``FIRST`` nodes of each document; from then on nodes that hold one component alone go.  A node
branches on while more than ``SMALL`` of its documents lie outside its largest component; the nodes that end have rounds of their own.  A node of at most ``WHOLE`` documents is followed down to its ends
within one task, and of an end only documents come back that have one of another component there whose minima agree often enough: a common passage so makes no rows of documents that are alike in nothing else.  In the end all pairs of a node that are still in different components, and whose 256 minima agree often enough, are
confirmed: those outside the node's largest component against all of the node, in blocks of at most SMALL, where each document's text comes once; the pairs themselves aren't listed. (First each document only with the one of other components that its minima agree with most, so that a loose group joins before its other pairs are listed.) That is linear in a node's size as long as few lie outside; the exact way for nodes that stay large at
the last depth.  Links are confirmed on full sets.

Recall: a pair at the threshold shares a root child in 1 - 0.25 ** (root tokens) of cases, over 0.9999; for pairs in nodes that branch to
DEPTH it stays over 0.99 with TREES trees.  The agreement of minima that is asked for lies 3.4 standard deviations under the threshold.

Defined results: null, empty or blank text has no set (n_shingles 0), links with nothing and is kept; equal texts are in one component; rows that share an id are one
node of the graph; a row without id links with nothing, has a null component and is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BASES, U64, Scratch, components, mix64, signed, text_blocks
from spanloom.llm.shingles import linked, shingle_hashes, shingle_sets

#: Minwise tokens (16 bits of each are kept); how far under the threshold their agreement may lie.
K, SLACK = 256, 0.092
TREES, SMALL, DEPTH, ROUNDS = 12, 512, 6, 2
#: Root children of each document in which large groups of near copies are joined first, before any other node is looked at.
FIRST = 4
#: Documents of a node whose minima one task holds (512 bytes each).
WHOLE = 1 << 16
#: Ids up to this many are broadcast to pick the texts to confirm; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_XOR = mix64(np.arange(101, 101 + K, dtype=np.uint64))
_MUL = mix64(np.arange(901, 901 + K, dtype=np.uint64)) | U64(1)


def selected(node: np.ndarray, similarity: float) -> np.ndarray:
    """(nodes, K) booleans: the hash functions that a node branches by."""
    limit = U64(int(2**64 / (similarity * K)))
    return mix64(node[:, None] ^ _XOR[None, :]) < limit


def child(node: np.ndarray, j: np.ndarray, minimum: np.ndarray) -> np.ndarray:
    return mix64(mix64(node ^ _MUL[j]) + minimum)


ROOTS = mix64(np.arange(5001, 5001 + TREES, dtype=np.uint64))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(K, np.iinfo(np.uint64).max, dtype=U64)
    for k in range(0, len(s), 256):  # a block that stays in cache
        part = s[k : k + 256, None] ^ _XOR[None, :]
        part *= _MUL[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, id_col: str, similarity: float) -> DataFrame:
    """(id, n_shingles, c1, c2, sig, nodes) of every row: the set's size, 128 bits of its hash, 256 minima, and its nodes below the roots."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, j = np.nonzero(selected(ROOTS, similarity))
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text"):
                n, c1, c2, sig, nodes = [], [], [], [], []
                for s in shingle_sets(data, offsets):
                    n.append(len(s))
                    c1.append(int(np.bitwise_xor.reduce(mix64(s ^ BASES[0]))) if len(s) else 0)
                    c2.append(int(mix64(s ^ BASES[1]).sum(dtype=U64)) if len(s) else 0)
                    m = minima(s)
                    sig.append(m.astype(np.uint16).tobytes() if len(s) else None)
                    nodes.append(signed(child(ROOTS[tree], j, m[j])) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(c1, U64))), pa.array(signed(np.array(c2, U64))), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "c1", "c2", "sig", "nodes"],
                )

    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(sketch, f"id {kind}, n_shingles long, c1 long, c2 long, sig binary, nodes array<long>")


def branch(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, id) of the children of (node, id, sig) rows."""
    kind = rows.schema["id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy().view(U64)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(-1, K)
            row, j = np.nonzero(selected(node, similarity))
            made = child(node[row], j, sig[row, j].astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(made)), batch.column(1).take(pa.array(row))], names=["node", "id"])

    return rows.select("node", "id", "sig").mapInArrow(step, f"node long, id {kind}")


def agreements(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many of the K minima of each row equal those of one."""
    same = (sig == one).view(U64).sum(axis=1, dtype=U64)  # eight counts side by side, of at most K / 8
    return same.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


def partnered(sig: np.ndarray, size: np.ndarray, part: np.ndarray, least: float, percent: int) -> np.ndarray:
    """Booleans: the rows that have one of another part, of a size and with minima that let them be linked. part: 0 for the largest."""
    out = np.zeros(len(part), dtype=bool)
    for q in np.flatnonzero(part):
        other = np.flatnonzero((part != part[q]) & (100 * np.minimum(size, size[q]) >= percent * np.maximum(size, size[q])))
        hit = other[agreements(sig[other], sig[q]) >= least * K]
        out[hit] = True
        out[q] |= len(hit) > 0
    return out


def descended(rows: DataFrame, similarity: float, percent: int, depth: int, tasks: int) -> DataFrame:
    """(node, id) of the ends below large nodes of that depth, each of at most WHOLE rows (node, id, component, n, sig): as by branch, level by level, but without the documents that have no partner in an end (see partnered).
    Ends that are still large at the last depth come back whole."""
    kind = rows.schema["id"].dataType.simpleString()

    def ends(node: np.ndarray, sig: np.ndarray, size: np.ndarray, part: np.ndarray, at: np.ndarray, level: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
        _, own, many = np.unique(part[at], return_inverse=True, return_counts=True)
        if len(many) < 2:
            return
        outside = len(at) - many.max()
        if min(len(at), outside) <= SMALL:
            on = at[partnered(sig[at], size[at], np.where(own == many.argmax(), 0, own + 1), similarity - SLACK, percent)]
            if len(on):
                yield node[0], on
        elif level == DEPTH - 1:
            yield node[0], at
        else:
            for j in np.flatnonzero(selected(node, similarity)[0]):
                token = sig[at, j]
                order = np.argsort(token, kind="stable")
                cuts = np.flatnonzero(np.diff(token[order])) + 1
                for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(at)), strict=True):
                    if hi - lo > 1:
                        some = at[order[lo:hi]]
                        yield from ends(child(node, np.array([j]), sig[some[:1], j].astype(U64)), sig, size, part, some, level + 1)

    def descend(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t["id"].combine_chunks()
        part = t["component"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint16).reshape(-1, K)
        got = list(ends(t["node"].to_numpy()[:1].view(U64), sig, t["n"].to_numpy(), part, np.arange(len(ids)), depth))
        of = np.array([x for x, _ in got], dtype=U64).repeat([len(at) for _, at in got])
        at = np.concatenate([x for _, x in got]) if got else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed(of)), ids.take(pa.array(at))], names=["node", "id"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(node)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(node)), strict=True):
                if held and own != node[lo]:
                    yield descend(held)
                    held = []
                own = node[lo]
                held.append(batch.slice(int(lo), int(hi - lo)))
        if held:
            yield descend(held)

    rows = rows.select("node", "id", "component", "n", "sig").repartition(tasks, "node").sortWithinPartitions("node")
    return rows.mapInArrow(walk, f"node long, id {kind}").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough. texts: (id, text)."""
    kind = pairs.schema["a"].dataType.simpleString()
    at = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_a")), "a")
    at = at.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_b")), "b").select("a", "b", "_a", "_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "_a"):
                good = []
                column = part.column(3)
                for k, s in enumerate(shingle_sets(data, offsets)):
                    b = column[k].as_py()
                    if b != last:
                        raw = np.frombuffer((b or "").encode(), dtype=np.uint8)
                        last, of_last = b, np.unique(shingle_hashes(raw, np.array([0, len(raw)]))[0])
                    if linked(s, of_last, percent):
                        good.append(k)
                at = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return at.mapInArrow(confirm, f"a {kind}, b {kind}")


def across(rows: DataFrame, least: float, percent: int, best: bool) -> DataFrame:
    """Pairs of rows (node, block, id, component, outside, here, sig, n, nodes) that may be similar: one of another component, one of its block.

    best: of each document only the likeliest, as (a, b). Else all, as groups (node, block, part, doc, others, agree): each document of a group once, with the others that it is to be compared with there;
    a part has at most SMALL documents with others, so a group's rows are bounded and their number follows the rows, not the pairs.

    Rows come sorted by node and block; a block has at most a few times SMALL rows of its own, while those of other components than the node's largest stand in all its blocks.
    nodes are all nodes of a document that rows hold: a pair is listed in the first node that it shares, and once there.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def pairs(at: list[pa.RecordBatch], here_node: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(at)
        ids, here = t["id"].combine_chunks(), t["here"].to_numpy()
        outside, size = t["outside"].to_numpy(), t["n"].to_numpy()
        part = t["component"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint16).reshape(-1, K)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        owner = np.repeat(np.arange(len(ids)), pc.list_value_length(t["nodes"]).to_numpy())
        earlier = pc.list_flatten(t["nodes"]).to_numpy()
        owner, earlier = owner[earlier < here_node], np.unique(earlier[earlier < here_node], return_inverse=True)[1]
        begin, own = np.searchsorted(owner, np.arange(len(ids) + 1)), np.zeros(len(earlier) + 1, dtype=bool)
        mine, left, right, likely = np.flatnonzero(here), [], [], []
        for q in np.flatnonzero(outside):
            other = mine[(part[mine] != part[q]) & (100 * np.minimum(size[mine], size[q]) >= percent * np.maximum(size[mine], size[q]))]
            if not best:
                other = other[~outside[other] | (rank[other] < rank[q])]
            agree = (sig[other] == sig[q]).sum(axis=1)
            hit = np.flatnonzero(agree >= least * K)
            if len(hit):
                met = np.zeros(len(ids), dtype=bool)
                own[earlier[begin[q] : begin[q + 1]]] = True
                met[owner[own[earlier]]] = True
                own[earlier[begin[q] : begin[q + 1]]] = False
                hit = hit[~met[other[hit]]]
            if best and len(hit):
                hit = hit[[agree[hit].argmax()]]
            left.append(np.full(len(hit), q))
            right.append(other[hit])
            likely.append(agree[hit])
        if not best:
            return grouped(here_node, t["block"][0].as_py(), ids, left, right, likely)
        left, right, likely = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, likely))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(likely)], names=["x", "y", "agree"])

    def grouped(node: int, block: int, ids: pa.Array, left: list[np.ndarray], right: list[np.ndarray], likely: list[np.ndarray]) -> pa.RecordBatch:
        some = [k for k, x in enumerate(left) if len(x)]
        part, doc, to, agree = [], [], [], []
        for k in range(0, len(some), SMALL):
            with_others = {int(left[x][0]): x for x in some[k : k + SMALL]}
            for d in sorted(with_others.keys() | set(np.concatenate([right[x] for x in with_others.values()]).tolist())):
                x = with_others.get(d)
                part.append(k // SMALL)
                doc.append(d)
                to.append(right[x] if x is not None else np.zeros(0, np.int64))
                agree.append(likely[x] if x is not None else np.zeros(0, np.int64))
        at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in to]))).astype(np.int32))
        others = pa.ListArray.from_arrays(at, ids.take(pa.array(np.concatenate([*to, np.zeros(0, np.int64)]))))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), node, np.int64)), pa.array(np.full(len(doc), block, np.int32)), pa.array(part, pa.int32()), ids.take(pa.array(doc, pa.int64())), others, pa.ListArray.from_arrays(at, pa.array(np.concatenate([*agree, np.zeros(0, np.int64)])))],
            names=["node", "block", "part", "doc", "others", "agree"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(node) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(node)])), strict=True):
                if held and key != (node[lo], block[lo]):
                    yield pairs(held, key[0])
                    held = []
                key = (node[lo], block[lo])
                held.append(batch.slice(int(lo), int(hi - lo)))
        if held:
            yield pairs(held, key[0])

    if not best:
        return rows.mapInArrow(walk, f"node long, block int, part int, doc {kind}, others array<{kind}>, agree array<long>")
    got = rows.mapInArrow(walk, f"x {kind}, y {kind}, agree long")
    got = got.groupBy("x").agg(F.max(F.struct("agree", "y"))["y"].alias("y"))
    return got.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed_in_groups(groups: DataFrame, texts: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (a, b) of groups (see across) by full sets, the likeliest first; a pair that the group's links already connect isn't compared. Each document's text meets its group once."""
    kind = groups.schema["doc"].dataType.simpleString()
    key = ["node", "block", "part"]
    at = groups.join(texts.select(F.col("id").alias("doc"), "text"), "doc").select(*key, "doc", "others", "agree", "text")

    def confirm(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sets = [s for rows in held for _, data, offsets in text_blocks(rows, "text") for s in shingle_sets(data, offsets)]
        t = pa.Table.from_batches([x.select(["doc", "others", "agree"]) for x in held]).combine_chunks()
        ids, others = t["doc"].combine_chunks(), t["others"].combine_chunks()
        names = ids.unique()
        node = pc.index_in(ids, names).to_numpy()  # rows that repeat an id are one node: each of its texts is compared
        rows_of, asked = np.argsort(node, kind="stable"), pc.index_in(pc.list_flatten(others), names).to_numpy()
        begin = np.searchsorted(node[rows_of], np.arange(len(names) + 1))
        many = begin[asked + 1] - begin[asked]
        left = np.repeat(np.repeat(np.arange(len(ids)), pc.list_value_length(others).to_numpy()), many)
        right = rows_of[np.repeat(begin[asked] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        agree = np.repeat(pc.list_flatten(t["agree"].combine_chunks()).to_numpy(), many)
        root, a, b = list(range(len(names))), [], []

        def of(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        order = np.argsort(-agree, kind="stable")
        for x, y in zip(left[order].tolist(), right[order].tolist(), strict=True):
            rx, ry = of(int(node[x])), of(int(node[y]))
            if rx != ry and linked(sets[x], sets[y], percent):
                root[rx] = ry
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in keys])) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, batch.num_rows), strict=True):
                this = tuple(int(x[lo]) for x in keys)
                if held and own != this:
                    yield confirm(held)
                    held = []
                own = this
                held.append(batch.slice(int(lo), int(hi - lo)))
        if held:
            yield confirm(held)

    return at.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(walk, f"a {kind}, b {kind}")


def meetings(rows: DataFrame, label: DataFrame | None, salt: int) -> DataFrame:
    """Pairs (a, b): of every document in rows (node, id) one pivot that it isn't connected with yet, that of the largest of its nodes that has one."""
    rows = labelled(rows.select("node", "id"), label)
    pivot = F.min(F.struct(F.xxhash64(F.lit(salt), "id").alias("h"), F.col("id").alias("p"), F.col("component").alias("of")))
    pivots = rows.groupBy("node").agg(F.count("*").alias("size"), pivot.alias("m")).where("size > 1").select("node", "size", "m.p", "m.of")
    pairs = rows.join(pivots, "node").where("component <> of")
    return pairs.groupBy("id").agg(F.max(F.struct("size", "node", "p"))["p"].alias("b")).select(F.col("id").alias("a"), "b")


def labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """rows with the component of their id; of an id without links, the id."""
    if label is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def divided(rows: DataFrame) -> DataFrame:
    """(node, id, component, size, main, outside) of the rows (node, id, component) whose node holds two components or more; outside: how many of its rows aren't of the largest, main."""
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("m"))
    nodes = parts.groupBy("node").agg(F.sum("m").alias("size"), F.max(F.struct("m", "component")).alias("of"), F.count("*").alias("parts")).where("parts > 1")
    return rows.join(nodes.select("node", "size", F.col("of.component").alias("main"), (F.col("size") - F.col("of.m")).alias("outside")), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row. See the module's text."""
    spark, similarity = docs.sparkSession, percent / 100
    scratch = Scratch(spark, "minhash")
    sk = scratch.keep(sketches(docs, id_col, similarity))
    some = sk.where("n_shingles > 0 AND id IS NOT NULL")
    classes = scratch.keep(some.groupBy("c1", "c2").agg(F.min(F.struct("id", "n_shingles", "sig", "nodes")).alias("r")).select("c1", "c2", "r.*"))
    reps = classes.select("id", F.col("n_shingles").alias("n"), "sig")
    sig_a, sig_b = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    in_roots = scratch.keep(classes.select("id", F.posexplode("nodes").alias("at", "node")))
    shared = in_roots.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    pool = in_roots.join(shared.select("node"), "node", "left_semi").select("id").distinct()
    pool = scratch.keep(pool)
    few = pool.count() <= BROADCAST_IDS
    texts = scratch.keep(docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(pool) if few else pool, "id", "left_semi"))

    done = (scratch.n - 2, scratch.n - 1, scratch.n)
    # Rows that share an id are one node of the graph, so the classes of their texts meet.
    repeated = some.groupBy("id").agg(F.min(F.struct("c1", "c2")).alias("x"), F.max(F.struct("c1", "c2")).alias("y")).where("x <> y").select("id")
    links = some.join(repeated, "id").join(classes.select("c1", "c2", F.col("id").alias("b")), ["c1", "c2"]).select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    links = scratch.keep(links)
    label = None if links.isEmpty() else components(links, scratch)

    def meet(rows: DataFrame, rounds: int) -> None:
        nonlocal links, label
        for r in range(rounds):
            pairs = meetings(rows, label, r).join(sig_a, "a").join(sig_b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
            more = scratch.keep(confirmed(alike(pairs, similarity - SLACK), texts, percent))
            if more.isEmpty():
                break
            links = links.unionByName(more)
            label = components(links, scratch)

    meet(in_roots.where(F.col("at") < FIRST), ROUNDS)
    scratch.settle()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier, found, first = labelled(in_roots.select("node", "id"), label), None, scratch.n + 1
    for depth in range(DEPTH):
        level = scratch.keep(divided(frontier))
        scratch.settle()
        last = depth == DEPTH - 1
        ended = (level if last else level.where(F.least("size", "outside") <= SMALL)).select("node", "id")
        found = ended if found is None else found.unionByName(ended)
        large = level.where(F.least("size", "outside") > SMALL)
        if last or large.isEmpty():
            break
        found = found.unionByName(scratch.keep(descended(large.where(f"size <= {WHOLE}").join(reps, "id"), similarity, percent, depth, n)))
        large = large.where(f"size > {WHOLE}")
        if large.isEmpty():
            break
        frontier = labelled(branch(large.join(reps.select("id", "sig"), "id"), similarity).distinct(), label)
    levels = range(first, scratch.n + 1)
    found = scratch.keep(found)
    scratch.drop(*levels)
    meet(found, 1)

    for best in (True, False):
        rows = scratch.keep(divided(labelled(found, label)).withColumn("outside", F.col("component") != F.col("main")))
        nodes = rows.groupBy("id").agg(F.collect_list("node").alias("nodes"))
        rows = rows.withColumn("blocks", F.ceil(F.col("size") / SMALL).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
        all_blocks = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
        rows = rows.withColumn("block", F.explode(all_blocks)).withColumn("here", F.col("block") == F.col("own"))
        rows = rows.join(reps.join(nodes, "id"), "id").select("node", "block", "id", "component", "outside", "here", "sig", "n", "nodes")
        pairs = across(rows.repartition(n, "node", "block").sortWithinPartitions("node", "block"), similarity - SLACK, percent, best)
        pairs = scratch.keep(pairs)
        more = scratch.keep(confirmed(pairs, texts, percent) if best else confirmed_in_groups(pairs, texts, percent, n))
        scratch.settle()
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(links, scratch)
    comp = labelled(classes.select("id"), label).select(F.col("id").alias("node"), "component")
    scratch.drop(*done)  # the result reads the sketches, the classes and the components

    of_class = classes.select("c1", "c2", "id").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("c1", "c2", F.coalesce("component", "id").alias("component"))
    out = sk.select("id", "n_shingles", "c1", "c2").join(of_class, ["c1", "c2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b) of pairs (a, b, sa, sb) whose minima agree in at least that share."""
    kind = pairs.schema["a"].dataType.simpleString()

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, K) for k in (2, 3))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least * K)).select([0, 1])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(agree, f"a {kind}, b {kind}")
