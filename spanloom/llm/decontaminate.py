"""Benchmark decontamination: CGK embedding, bit sampling and exact edit distance.

Texts are sequences of words (A-Z lower-cased).  The CGK embedding walks along a sequence: at step j it writes the word under its pointer and moves on if a random bit of (j, word) says so.
Sequences a few edits apart fall into step again, so edit distance becomes Hamming distance.  Bit sampling hashes a few positions of the embedding: one band.  ``WALKS`` walks with
``BANDS`` bands each are repeated for windows that begin at every ``stride``-th word of a document.

Items are embedded at each of their offsets.  So whichever window falls into a passage has its aligned counterpart: the window of the item's size that begins offset words earlier.
A passage of n words holds about n / stride windows, each with WALKS * BANDS tries.  With exact copies the first try hits; with every fifth word edited one try hits with a chance of about 0.3 (measured), so that
a passage of 30 words is found in over 0.99 of cases.

Candidates are confirmed exactly: the least number of edited words (inserted, dropped or replaced) between the item and any stretch of the document around the window, at most ``share`` of the item's words.
Before, a lossless test drops those that lack more of the item's words than that.

Items go to all tasks in parts of at most ``PART_BYTES``; a larger benchmark takes several passes.  Nothing is shuffled.

Defined results: null or empty texts and items match nothing; each row is searched whole and by itself, so repeated rows repeat their hits; items that share an id answer with the nearest;
an item shorter than six words is sought by single words as well (a walk need not leave a band within so few), and must be there without an edit if share * words is below one; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import TO_LOWER, U64, Rolling, mix64, text_blocks, words_of

WALKS, STEPS, PART_BYTES = 3, 28, 32 << 20
#: Positions of the embedding that a band samples, and the items it is for: those under so many words.
BANDS = ((0,), (0, 3, 7), (1, 6, 11, 16), (2, 9, 18, 27))
UNDER = (6, 24, 1 << 60, 1 << 60)
_WALK = mix64(np.arange(701, 701 + WALKS, dtype=np.uint64))
_BAND = mix64(np.arange(1, 1 + WALKS * len(BANDS), dtype=np.uint64))


def walk(symbols: np.ndarray, bits: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step, pointers, symbols under them) of one walk for windows that begin at ``at``; pointers stay at the last symbol of the array."""
    at = at.copy()
    for j in range(STEPS):
        yield j, at, symbols[at]
        at += ((bits[at] >> U64(j)) & U64(1)).astype(np.int64)
        np.minimum(at, len(symbols) - 1, out=at)


def bands(symbols: np.ndarray, at: np.ndarray, end: np.ndarray | None = None, used: tuple[int, ...] = (2, 3)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, keys, usable) for windows beginning at ``at``. end: where each one's sequence ends; a band that samples beyond isn't usable."""
    for w in range(WALKS):
        bits = mix64(symbols ^ _WALK[w])
        keys = {b: np.full(len(at), _BAND[w * len(BANDS) + b], dtype=U64) for b in used}
        good = {b: np.ones(len(at), dtype=bool) for b in keys}
        for j, where, symbol in walk(symbols, bits, at):
            for b in keys:
                if j in BANDS[b]:
                    keys[b] = mix64(keys[b] ^ symbol) * U64(0x9E3779B97F4A7C15)
                    if end is not None:
                        good[b] &= where < end
        for b in keys:
            yield w * len(BANDS) + b, keys[b], good[b]


def edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any stretch of region, and where the first such stretch ends."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for symbol in item:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (region != symbol), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = TO_LOWER[data]
    starts, ends, first = words_of(data, offsets)
    return (Rolling(data).spans(starts, ends) if len(starts) else np.zeros(0, U64)), first


class Items:
    """The benchmark's items, embedded at each offset: sorted band keys with their item and offset."""

    def __init__(self, texts: list[str], share: float, stride: int):
        raw = [(t or "").encode() for t in texts]
        at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        self.symbols, self.first = hashed_words(np.frombuffer(b"".join(raw), dtype=np.uint8), at)
        self.size = np.diff(self.first)
        self.most = (self.size * share + 1e-9).astype(np.int64)
        self.used = tuple(b for b in range(len(BANDS)) if ((self.size > 0) & (self.size < UNDER[b])).any())
        self.stride = stride
        item = np.repeat(np.arange(len(texts)), self.size)
        offset = np.arange(len(item)) - self.first[item]
        keys, owner = [], []
        if len(item):
            for b, key, good in bands(self.symbols, np.arange(len(item)), self.first[item + 1], self.used):
                good = good & (self.size[item] < UNDER[b % len(BANDS)])
                keys.append(key[good])
                owner.append(np.flatnonzero(good))
        keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], item[owner[order]], offset[owner[order]]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.keys >> U64(44)).astype(np.int64)] = True
        self.sets = [np.unique(self.symbols[a:b]) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def of(self, k: int) -> np.ndarray:
        return self.symbols[self.first[k] : self.first[k + 1]]

    def candidates(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, first word of the aligned window) rows."""
        n = np.diff(first)
        count = -(-n // self.stride)
        text = np.repeat(np.arange(len(n)), count)
        at = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * self.stride
        out = []
        if len(at) and len(self.keys):
            for _, key, _ in bands(symbols, at, None, self.used):
                maybe = np.flatnonzero(self.sieve[(key >> U64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(self.keys, key[maybe], side="left"), np.searchsorted(self.keys, key[maybe], side="right")
                many = hi - lo
                w = np.repeat(maybe, many)
                e = np.repeat(lo, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                out.append(np.stack((text[w], self.item[e], at[w] - first[text[w]] - self.offset[e]), axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def hits(self, symbols: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (distance, word after the stretch), the nearest and then the first."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, k, lo in self.candidates(symbols, first):
            item, most = self.of(k), int(self.most[k])
            a = first[text] + max(0, lo - most - 1)
            b = min(first[text + 1], first[text] + max(0, lo) + len(item) + 2 * most + 1)  # the window may lie up to most words off its aligned place
            region = symbols[a:b]
            if (text, k) in best and best[text, k][0] == 0:
                continue
            if len(item) - len(self.sets[k]) + int(np.isin(self.sets[k], region).sum()) < len(item) - most:
                continue
            distance, end = edits(item, region)
            found = (distance, int(a - first[text] + end))
            if distance <= most and found < best.get((text, k), (most + 1, 0)):
                best[text, k] = found
        return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", share: float = 0.2) -> DataFrame:
    """(id_col, item_col, distance, item_words, end_word): each row of docs and each item with a stretch of it that is near enough."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), "text").where("text IS NOT NULL AND item IS NOT NULL")
    volume, shortest = items.agg(F.sum(F.length("text")), F.min(F.size(F.split(F.btrim("text"), "\\s+")))).first()
    parts = 1 + (volume or 0) // PART_BYTES
    stride = max(1, min(4, ((shortest or 0) - 5) // 2))
    out = None
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p).orderBy("item", "text").collect()  # at most about PART_BYTES
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            known = Items(texts, share, stride)
            item_type = pa.array(ids).type if ids else pa.int64()
            for batch in batches:
                for part, data, offsets in text_blocks(batch, "text"):
                    symbols, first = hashed_words(data, offsets)
                    best: dict = {}
                    for (text, k), (distance, end) in known.hits(symbols, first).items() if len(symbols) else ():
                        found = (distance, end, int(known.size[k]))
                        if found < best.get((text, ids[k]), (1 << 60,)):
                            best[text, ids[k]] = found
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([t for t, _ in keys], pa.int64())), pa.array([i for _, i in keys], item_type), *[pa.array([best[k][c] for k in keys], pa.int64()) for c in (0, 2, 1)]],
                        names=[id_col, item_col, "distance", "item_words", "end_word"],
                    )

        got = docs.select(id_col, "text").mapInArrow(search, f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance long, item_words long, end_word long")
        out = got if out is None else out.unionByName(got)
    return out
