"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Which bytes are covered by a string of ``length`` bytes that also starts earlier?  One transform of a whole corpus doesn't fit in a task, so strings are first
dealt by content.  Every string of ``length`` bytes has one anchor: of its ``GRAM``-byte grams the one with the least hash (the leftmost on ties), which depends on
the string alone; so all copies of a string have the same anchor gram.  Consecutive strings with one anchor form a piece (their union, under 2 * length bytes).

1. Pieces are dealt by their gram and sorted within their task by gram, bytes (a 96-bit hash) and place. Read as a stream, equal pieces of a gram show their first occurrence and
   the later ones, all of whose strings start earlier there; grams of one piece only go.
2. What goes on is the first occurrence of each of the different pieces of a gram.
3. Different pieces of a gram meet in a bundle.  There the texts of the first occurrences are laid one after the other, each with an end of its own, their suffix array is sorted
   to ``length`` bytes by prefix doubling, and the longest common prefixes of neighbours are derived on the transform by increasing value: a border of value v between two rows that
   a letter precedes gives, one step backward by that letter, a border of value v + 1, unless that border has a lesser one already.  Stopping at ``length`` leaves the borders whose prefix is at
   least that long: maximal intervals of rows with a common string, of which the first in the corpus stays.
4. A gram with more than ``MOST`` different pieces is too much for one task; its strings are grouped by their own 128-bit hash instead, with an aggregate that is combined before its shuffle.
   Bands of ``BAND`` neighbouring strings whose common part (by a 96-bit hash) is there once go before: they have no copies.

Defined results: null and empty texts have zero bytes and no span; texts shorter than length are kept whole; matches never cross documents; rows that share an id are ordered by their text's hash
(equal ones are one occurrence, and get the same result); a null id sorts first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BASES, U64, Rolling, Scratch, signed, text_blocks

GRAM = 24
#: Different pieces of a gram that one task sorts: under 3.3 MB of text and about 250 MB of arrays.
MOST = 16_384
#: Neighbouring strings of such a gram that are looked at together before each by itself.
BAND = 8
#: Bytes of distinct pieces that a bundle holds on average.
BUNDLE = 1 << 20
#: A text longer than this many bytes is searched in overlapping stretches of this size, so that memory stays bounded.
STRETCH = 1 << 22

# ---------------------------------------------------------------- on one array


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of window grams the position of the least one, the leftmost on ties (a minimum by doubling)."""
    value, where, span = grams, np.arange(len(grams)), 1
    while span < window:
        step = min(span, window - span)
        left, right = value[:-step] if step else value, value[step:]
        take = right < left
        value, where = np.where(take, right, left), np.where(take, where[step:], where[:-step])
        span += step
    return where


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Rows sorted by their first depth letters at least; every text ends with a letter of its own, from 256 on, in the texts' order."""
    n, done = len(s), 7
    # Seven letters at once, nine bits each. An end closes its row's key, and the text it belongs to tells the row from all others.
    key, ended = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for k in range(done):
        letter = np.zeros(n, dtype=np.int64)
        letter[: max(0, n - k)] = np.minimum(s[k:], 256)
        letter[ended] = 0
        key = (key << np.int64(9)) | letter
        ended |= letter == 256
    order = np.argsort(key)
    alone = np.flatnonzero(ended[order])
    rows = order[alone]
    order[alone] = rows[np.lexsort((rows, key[rows]))]
    value = key[order]
    fresh = np.concatenate((np.ones(min(n, 1), dtype=bool), value[1:] != value[:-1]))
    fresh[alone] = True
    fresh[alone[alone + 1 < n] + 1] = True
    rank = np.empty(n, dtype=np.int64)  # the first place of a row's equals
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while done < depth:
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # rows that still have equals; those don't end within done letters
        if not len(tied):
            break
        rows = order[tied]
        key = (rank[rows] << np.int64(32)) | rank[rows + done]
        o = np.argsort(key)
        rows, key = rows[o], key[o]
        order[tied] = rows
        new = np.concatenate(([True], key[1:] != key[:-1]))
        fresh[tied] = new
        rank[rows] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        done *= 2
    return order


def long_borders(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True where a row shares fewer than depth letters with the row before: breadth-first over values, backward on the transform."""
    n, value = len(s), 1
    last = s[order - 1]  # the transform: the letter before each row; the first text's start is preceded by the last text's own end
    last = last.astype(np.uint16) if n and s.max() < 1 << 16 else last
    by_letter = np.argsort(last, kind="stable")  # rows by the letter before them: the k-th goes to row k one step backward
    to = np.flatnonzero(last[by_letter][1:] == last[by_letter][:-1]) + 1
    p, q = by_letter[to - 1], by_letter[to]  # neighbours of one letter, and to, the border between them one step backward
    border = np.ones(n, dtype=bool)
    border[to] = False  # value 0: the letters themselves differ
    fresh = to[:0]
    while value < depth:
        before = np.cumsum(border, dtype=np.int32)
        hit = before[q] > before[p]  # a border of a lesser value lies between them
        fresh, value = to[hit], value + 1
        border[fresh] = True
        p, q, to = p[~hit], q[~hit], to[~hit]
        if not len(fresh) or (q - p).sum() <= 2 * n:
            break
    # Between neighbours that are left lie only rows without a border, and the borders of the last value: these alone lead on.
    if value < depth and len(fresh):
        size = q - p
        between = np.repeat(p + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        goal = np.repeat(to, size)[np.argsort(between)]
        at = np.concatenate(([0], np.cumsum(np.bincount(between, minlength=n))))
        while value < depth and len(fresh):
            many = at[fresh + 1] - at[fresh]
            goals = goal[np.repeat(at[fresh] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            fresh, value = np.unique(goals[~border[goals]]), value + 1
            border[fresh] = True
    return border


def repeats(pieces: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, group) of every string of length bytes that occurs more than once in the pieces."""
    size = np.array([len(x) for x in pieces])
    at = np.concatenate(([0], np.cumsum(size + 1)))
    s = np.empty(at[-1], dtype=np.int64)
    for k, x in enumerate(pieces):
        s[at[k] : at[k + 1] - 1] = x
        s[at[k + 1] - 1] = 256 + k
    order = suffix_array(s, length)
    border = long_borders(s, order, length)
    group = np.cumsum(border) - 1
    many = np.bincount(group)[group] > 1
    rows, group = order[many], group[many]
    piece = np.searchsorted(at, rows, side="right") - 1
    return piece, rows - at[piece], group


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of half-open intervals."""
    if not len(lo):
        return lo, hi
    o = np.argsort(lo, kind="stable")
    lo, reach = lo[o], np.maximum.accumulate(hi[o])
    fresh = np.concatenate(([True], lo[1:] > reach[:-1]))
    return lo[fresh], reach[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(lo) - 1]))]


# ---------------------------------------------------------------- on tables


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """(gram, p1, p2, id, pos, n) of every piece: its anchor's hash, 96 bits of its own hash, its document, its place and its length.

    A place is 31 bits of the text's hash (so that rows that share an id are told apart) and the first byte.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text", 1 << 19):
                text_bits = part.column(1).to_numpy()
                for begin in range(0, max(1, len(data) - length + 1), STRETCH):
                    d = data[begin : begin + STRETCH + length - 1]
                    if len(d) < length:
                        continue
                    first, second = Rolling(d), Rolling(d, BASES[1])
                    at = np.arange(len(d) - GRAM + 1)
                    grams = first.spans(at, at + GRAM)
                    anchor = anchors(grams, length - GRAM + 1)
                    text = np.searchsorted(offsets, np.arange(len(anchor)) + begin, side="right") - 1
                    whole = np.arange(len(anchor)) + begin + length <= offsets[text + 1]
                    turn = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                    lo = np.flatnonzero(whole & np.concatenate(([True], turn)))
                    hi = np.flatnonzero(whole & np.concatenate((turn | ~whole[1:], [True]))) + length
                    row = text[lo]
                    pos = (text_bits[row] << 32) | (lo + begin - offsets[row])
                    p2 = (second.spans(lo, hi) >> U64(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(grams[anchor[lo]])), pa.array(signed(first.spans(lo, hi))), pa.array(p2), part.column(0).take(pa.array(row)), pa.array(pos), pa.array((hi - lo).astype(np.int32))],
                        names=["gram", "p1", "p2", "id", "pos", "n"],
                    )

    return docs.select("id", "bits", "text").mapInArrow(find, f"gram long, p1 long, p2 int, id {kind}, pos long, n int")


def judged(found: DataFrame) -> DataFrame:
    """Of pieces sorted by gram, own hash and place: the later ones of equal pieces (later is true), and the first ones of grams with different pieces.

    A piece at the place of the one before comes from a row that repeats its id and text; it is the same occurrence.
    Reads each partition as a stream and holds one batch, so a gram of any size needs no memory of its own.
    """
    columns = ["gram", "p1", "p2", "id", "pos", "n"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, own, waiting, before = None, None, None, None  # of the last row; waiting: a gram's only class so far; before: the last row's place
        for batch in batches:
            if not batch.num_rows:
                continue
            g, a, b = (batch.column(k).to_numpy() for k in range(3))
            same_gram = np.concatenate(([gram is not None and g[0] == gram], g[1:] == g[:-1]))
            same = same_gram & np.concatenate(([own is not None and (a[0], b[0]) == own], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
            pos = batch.column(4).to_numpy()
            again = np.flatnonzero(same & np.concatenate(([before is not None and pos[0] == before[1]], pos[1:] == pos[:-1])))
            ids = pa.concat_arrays([pa.array([before[0] if before else None], batch.column(3).type), batch.column(3)]).dictionary_encode("encode").indices.to_numpy() if len(again) else None
            again = again[ids[again] == ids[again + 1]] if len(again) else again
            before = batch.column(3)[-1].as_py(), pos[-1]
            new = np.flatnonzero(~same)  # first of their class
            opens = ~same_gram[new]  # and of their gram
            follows = np.concatenate((~opens[1:], [False]))  # another class of the gram comes in this batch
            if waiting is not None and len(new):
                if not opens[0]:
                    yield waiting
                waiting = None
            out = new[~opens | follows]
            if len(new) and opens[-1]:
                waiting = flagged(batch.slice(int(new[-1]), 1), False)
            gram, own = g[-1], (a[-1], b[-1])
            same[again] = False
            yield flagged(batch.take(pa.array(np.flatnonzero(same))), True)
            yield flagged(batch.take(pa.array(out)), False)

    def flagged(rows: pa.RecordBatch, later: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, later))], names=[*columns, "later"])

    kind = found.schema["id"].dataType.simpleString()
    return found.select(*columns).mapInArrow(walk, f"gram long, p1 long, p2 int, id {kind}, pos long, n int, later boolean")


def with_bytes(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of firsts (gram, p1, p2, id, pos, n) with the bytes of their pieces; rows of docs that share id and text answer more than once."""
    asked = firsts.withColumn("bits", F.shiftright("pos", 32)).groupBy("id", "bits").agg(F.collect_list(F.struct("gram", "p1", "p2", "pos", "n")).alias("asked"))
    both = docs.join(asked, docs["id"].eqNullSafe(asked["id"]) & (docs["bits"] == asked["bits"])).select(docs["id"], F.encode("text", "UTF-8").alias("raw"), "asked")
    flat = both.select("id", "raw", F.explode("asked").alias("x"))
    first = F.col("x.pos").bitwiseAND((1 << 32) - 1).cast("int") + 1
    return flat.select("x.gram", "x.p1", "x.p2", "id", "x.pos", F.substr("raw", first, F.col("x.n")).alias("bytes"))


def expand(bundled: DataFrame, length: int) -> DataFrame:
    """(id, pos, n): stretches of a first occurrence's strings that start earlier in another piece of its gram. bundled: (bundle, gram, p1, p2, id, pos, bytes) sorted by bundle, id and pos."""
    kind = bundled.schema["id"].dataType.simpleString()

    def search(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        p = np.stack([t[c].to_numpy() for c in ("gram", "p1", "p2")], axis=1)
        _, once = np.unique(p, axis=0, return_index=True)
        t = t.take(pa.array(np.sort(once)))  # rows stay in the corpus' order
        piece, offset, group = repeats([np.frombuffer(x, dtype=np.uint8) for x in t["bytes"].to_pylist()], length)
        o = np.lexsort((offset, piece, group))
        piece, offset, group = piece[o], offset[o], group[o]
        later = np.concatenate(([False], group[1:] == group[:-1])) if len(group) else np.zeros(0, bool)
        piece, offset = piece[later], offset[later]
        o = np.lexsort((offset, piece))
        piece, offset = piece[o], offset[o]
        fresh = np.concatenate(([True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(piece) else np.zeros(0, bool)
        a = np.flatnonzero(fresh)
        b = np.concatenate((a[1:] - 1, [len(piece) - 1])) if len(a) else a
        pos = t["pos"].to_numpy()[piece[a]]
        return pa.RecordBatch.from_arrays([t["id"].combine_chunks().take(pa.array(piece[a], pa.int64())), pa.array(pos + offset[a]), pa.array((offset[b] - offset[a] + length).astype(np.int64))], names=["id", "pos", "n"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            bundle = batch.column(0).to_numpy()
            if not len(bundle):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bundle)) + 1, [len(bundle)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key != bundle[lo]:
                    yield search(held)
                    held = []
                key = bundle[lo]
                held.append(batch.slice(int(lo), int(hi - lo)))
        if held:
            yield search(held)

    return bundled.mapInArrow(walk, f"id {kind}, pos long, n long")


def bands(rows: DataFrame, length: int) -> DataFrame:
    """(p1, p2, id, pos, bytes): of each piece of rows (gram, id, pos, bytes) its strings in bands of ``BAND`` neighbours, as shorter pieces with 96 bits of the hash of what all strings of the band have in common.

    Bands are counted from the piece's gram (its first place in the piece is the anchor), so copies of a string lie in the same band and share its common part: a common part that is there once has no copies.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                raw = part.column(3).to_pylist()
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                size = np.array([len(x) for x in raw])
                at = np.cumsum(size) - size
                first, second = Rolling(data), Rolling(data, BASES[1])
                place = np.arange(len(data) - GRAM + 1)
                piece = np.searchsorted(at, place, side="right") - 1
                here = np.flatnonzero(signed(first.spans(place, place + GRAM)) == part.column(0).to_numpy()[piece])
                here = here[here + GRAM <= (at + size)[piece[here]]]
                anchor = here[np.searchsorted(piece[here], np.arange(len(raw)))]
                # Strings start from at to at + size - length; band b holds those that start up to b * BAND bytes before the gram, but not BAND more.
                low, high = (anchor - at - size + length) // BAND, (anchor - at) // BAND
                count = high - low + 1
                row = np.repeat(np.arange(len(raw)), count)
                b = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                core = anchor[row] - b * BAND
                lo = np.maximum(at[row], core - BAND + 1)
                n = np.minimum(core, (at + size)[row] - length) - lo + length
                p1, p2 = (x.spans(core, core - BAND + 1 + length) for x in (first, second))
                p2 = (p2 >> U64(32)).astype(np.uint32).view(np.int32)
                pos = part.column(2).to_numpy()[row] + lo - at[row]
                held = pa.array([data[a : a + m].tobytes() for a, m in zip(lo, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(p1)), pa.array(p2), part.column(1).take(pa.array(row)), pa.array(pos), held], names=["p1", "p2", "id", "pos", "bytes"])

    return rows.select("gram", "id", "pos", "bytes").mapInArrow(find, f"p1 long, p2 int, id {kind}, pos long, bytes binary")


def strings(rows: DataFrame, length: int) -> DataFrame:
    """(s1, s2, id, pos) of every string of rows (id, pos, bytes): the way of grams with too many pieces."""
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                raw = part.column(2).to_pylist()
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                size = np.array([len(x) for x in raw])
                at, count = np.cumsum(size) - size, size - length + 1
                row = np.repeat(np.arange(len(raw)), count)
                o = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lo = at[row] + o
                yield pa.RecordBatch.from_arrays([pa.array(signed(Rolling(data, b).spans(lo, lo + length))) for b in BASES] + [part.column(0).take(pa.array(row)), pa.array(part.column(1).to_numpy()[row] + o)], names=["s1", "s2", "id", "pos"])

    return rows.select("id", "pos", "bytes").mapInArrow(find, f"s1 long, s2 long, id {kind}, pos long")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """(id, bits, spans array<struct<lo, n>>) of the documents (id, bits, text) that lose bytes; spans may overlap."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct("id", "pos")
    by_gram = pieces(docs, length).repartition(n, "gram").sortWithinPartitions("gram", "p1", "p2", "id", "pos")
    known = scratch.keep(judged(by_gram))
    scratch.settle()
    equal = known.where("later").select("id", "pos", F.col("n").cast("long").alias("n"))
    varied = known.where("NOT later").drop("later")
    many = scratch.keep(varied.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST).select("gram"))

    some_hot = not many.isEmpty()
    whole = scratch.keep(with_bytes(varied, docs)) if some_hot else None  # texts are dealt once for both ways
    volume = varied.agg(F.sum("n")).first()[0] or 0
    bundles = max(1, volume // BUNDLE)
    usual = whole.join(many, "gram", "left_anti") if some_hot else with_bytes(varied, docs)
    usual = usual.withColumn("bundle", F.pmod(F.xxhash64("gram"), F.lit(bundles)))
    usual = usual.repartition(max(1, min(bundles, max(n, bundles // 8))), "bundle").sortWithinPartitions("bundle", "id", "pos")
    varying = scratch.keep(expand(usual.select("bundle", "gram", "p1", "p2", "id", "pos", "bytes"), length))
    scratch.settle()

    hot = None
    if some_hot:
        parts = scratch.keep(bands(whole.join(many, "gram"), length))
        copied = parts.groupBy("p1", "p2").agg(F.count("*").alias("_many")).where("_many > 1").select("p1", "p2")
        hot = scratch.keep(strings(parts.join(copied, ["p1", "p2"], "left_semi"), length))
        scratch.settle()
    every = equal.unionByName(varying)
    if hot is not None:
        first = hot.groupBy("s1", "s2").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").drop("l")
        every = every.unionByName(hot.join(first, ["s1", "s2"]).where(~place.eqNullSafe(F.col("f"))).select("id", "pos", F.lit(length).cast("long").alias("n")))
    every = every.select("id", F.shiftright("pos", 32).alias("bits"), F.col("pos").bitwiseAND((1 << 32) - 1).alias("lo"), "n")
    return every.groupBy("id", "bits").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", length: int = 100) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, spans, kept) of every row: the removed runs of bytes and the bytes that stay. See the module's text."""
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("bits", F.xxhash64("text").bitwiseAND((1 << 31) - 1))
    gone = scratch.keep(repeated_spans(d, scratch, length))
    scratch.settle()
    both = d.join(gone, d["id"].eqNullSafe(gone["id"]) & (d["bits"] == gone["bits"]), "left").select(d["id"], "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text", 1 << 22):
                size, removed, spans, kept = [], [], [], []
                given = part.column(2)
                for k in range(part.num_rows):
                    d = data[offsets[k] : offsets[k + 1]]
                    pairs = given[k].values.flatten() if given[k].is_valid else None
                    lo, n = (x.to_numpy() for x in pairs) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    lo, hi = merged(lo, lo + n)
                    step = np.zeros(len(d) + 1, dtype=np.int32)
                    step[lo] += 1
                    step[hi] -= 1
                    size.append(len(d))
                    removed.append(int((hi - lo).sum()))
                    spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)])
                    kept.append(d[np.cumsum(step[:-1]) == 0].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    return both.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<lo: long, hi: long>>, kept binary")
