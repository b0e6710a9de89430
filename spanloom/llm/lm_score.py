"""LM scoring by online logistic context mixing.

A text is read as its words (A-Z lower-cased) with a space after each, then an end.  Every byte of that is spelled in bits by a Huffman code of the corpus' byte counts.  A predictor for each of three contexts
(the last two bytes, the last three, and the whole word so far) looks up how often the bit was 0 and 1 after its context at this place of the code, and gives a stretched probability.  A fourth follows passages: at an anchor (two words whose
hash says so, one place in ``EVERY``) it looks up how the training texts most often go on from there to the next anchor, and predicts those bytes until one is wrong.  A gate (is there a passage, how far has it been right, has the place been seen after the word so far) selects a set of weights;
their weighted sum is the mixed prediction.  After every GROUP bits the sets are refined by the gradient of the bits' coding cost.  The costs add up to the text's total, in bits per byte or as log10 probability.
Contexts, passages, gate and weights depend on earlier bits alone, so the probabilities of all continuations add up to one.

Counts are gathered from every training text.  Those after the word so far are exact and grow with the corpus: they are the counts of the vocabulary's branches.  The vocabulary (every distinct token of docs with its training count) is dealt
in ranges of its sorted words; the branches of a range are found by reading the words side by side, letter by letter.  Branches that a border of ranges cuts (beginnings of the border words) are summed over ranges first. So each
distinct word gets the stretched predictions of all bits of its spelling once, however often it occurs.  Counts after three bytes are kept in ``BUCKETS`` hashed contexts, those after two bytes exactly: tables of
2 * 2**24 bytes at most, which go to all tasks.  Passages are counted as keys by the hash of their anchor, without their bytes.

Each block of documents (hash of id and text, about ``BLOCK`` bytes) gets the counts and predictions of its own distinct words, and the passages of its own anchors, by joins; so no task or the driver holds the vocabulary.
Of a word's predictions only those up to its last branch are rows, as its rest follows from its count.  Of a passage a block gets the key; where all its texts go on that way, they hold the bytes themselves, and only passages
that some block asks for beside another are read again from the training texts (a table of ``PLACES`` bits tells which may be).
Weights are refined through the whole text, from ``WEIGHTS`` at its start (a group also ends after every ``STRETCH`` words of a text, which bounds memory); so a score depends on the counts and the text alone, not on its neighbours, and many texts run in step as arrays.

Beside the score there is a unigram base, from the same counts of words.

Defined results: null, empty and blank texts have the end as their only token; without training texts all counts are 0 (every bit has probability 1/2); repeated rows are scored one by one (and learned from each);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import TO_LOWER, U64, Rolling, Scratch, mix64, signed, text_blocks, words_of

BLOCK, PIECE, STRETCH = 24 << 20, 1 << 20, 1 << 17
#: Hashed contexts of three bytes.
BUCKETS = 1 << 16
#: Distinct words of a range of the vocabulary; words sampled for each border; bytes of a border.
RANGE, SAMPLED, BORDER = 150_000, 64, 48
#: Bits between two refinements of the weights; their rate; what is added to counts; scale and bound of stretched predictions.
GROUP, RATE, PRIOR, SCALE, MOST = 128, 0.004, 0.05, 15.0, 8.0
#: Texts that are read in step; groups of bits that wait for it (640 bytes each).
LANES, HELD = 128, 1 << 15
#: Anchors are one in so many places; words of a passage at most; the strength of its bits; bytes after which it is far.
EVERY, PASSAGE, SURE, FAR = 16, 64, 45, 16
#: Bits by which wanted passages are told before their keys are compared (8 MB).
PLACES = 1 << 26
#: First weights of the four predictors by gate: no passage, one that has been right for a while, one that has been right for FAR bytes; each for word so far unseen and seen.
WEIGHTS = ((0.35, 0.65, 0.0, 0.0), (0.1, 0.5, 0.4, 0.0), (0.1, 0.3, 0.0, 1.2), (0.0, 0.25, 0.5, 1.25), (0.0, 0.2, 0.0, 2.0), (0.0, 0.2, 0.5, 2.1))
SPACE, END = 32, 10
END_TOKEN = np.int64(-0x123456789ABCDEF)


def trim() -> None:
    """Gives a worker's free memory back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step, after which a worker, which outlives it, gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        trim()

    return run


class Code:
    """A Huffman code: for each byte its length and where its path begins in ``node`` (the inner nodes it passes) and ``bit`` (what it takes there)."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        fresh = 256
        while len(heap) > 1:
            x, y = heapq.heappop(heap), heapq.heappop(heap)
            parent[x[2]], parent[y[2]] = (fresh, 0), (fresh, 1)
            heapq.heappush(heap, (x[0] + y[0], fresh, fresh))
            fresh += 1
        paths = []
        for b in range(256):
            path, k = [], b
            while k in parent:
                k, bit = parent[k]
                path.append((k - 256, bit))
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths])
        self.first = np.cumsum(self.size) - self.size
        self.node = np.array([x for p in paths for x, _ in p], dtype=np.int64)
        self.bit = np.array([x for p in paths for _, x in p], dtype=np.int8)
        #: How many bits two bytes' paths share.
        self.common = np.array([[next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), len(p)) for q in paths] for p in paths])

    def bits(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol's index, place in node and bit) of all bits of symbols, in order."""
        long = self.size[symbol]
        of = np.repeat(np.arange(len(symbol)), long)
        return of, np.arange(len(of)) + np.repeat(self.first[symbol] - (np.cumsum(long) - long), long)


def stretched(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Predictions in SCALE-ths: 0 for what hasn't been seen, and for nothing else."""
    st = np.rint(np.clip(np.log((one + PRIOR) / (zero + PRIOR)), -MOST, MOST) * SCALE)
    return np.where(one + zero == 0, 0, np.where(st == 0, 1, st)).astype(np.int8)


# ---------------------------------------------------------------- texts as tokens and bytes


class Tokens:
    """The tokens of texts in data: hashes, spelled bytes, where each token's and each text's begin (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = TO_LOWER[data]
        starts, ends, first = words_of(self.low, offsets)
        texts = len(offsets) - 1
        self.first = first + np.arange(texts + 1)  # an end follows each text's words
        word = np.ones(self.first[-1], dtype=bool)
        word[self.first[1:] - 1] = False
        self.begin, self.size = np.zeros(len(word), np.int64), np.ones(len(word), np.int64)
        self.begin[word], self.size[word] = starts, ends - starts + 1
        self.hash = np.full(len(word), END_TOKEN)
        if len(starts):
            self.hash[word] = signed(Rolling(self.low).spans(starts, ends))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the two words, first token after them, where the passage ends) of every anchor."""
        h = self.hash.view(U64)
        both = mix64(mix64(h[:-1]) + h[1:])
        second = np.ones(len(both), dtype=bool)  # of two words of one text
        second[self.hash[1:] == END_TOKEN] = False
        second[self.hash[:-1] == END_TOKEN] = False
        at = np.flatnonzero(second & (both % U64(EVERY) == 0))
        start = at + 2
        text_end = self.first[np.searchsorted(self.first, at, side="right")]
        return signed(both[at]), start, np.minimum(np.minimum(np.append(start[1:], len(h)), text_end), start + PASSAGE)

    def passage_keys(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """What stands for the passages of tokens lo to hi: up to four letters of the first word, which order equal counts and sizes, and 32 bits of a hash."""
        front = np.zeros(len(lo), dtype=np.int64)
        for k in range(4):
            inside, over = k < self.size[lo] - 1, k == self.size[lo] - 1
            letter = self.low[np.where(inside, self.begin[lo] + k, 0)] if len(self.low) else 0
            front = front << 8 | np.where(inside, letter, np.where(over, np.where(self.hash[lo] == END_TOKEN, END, SPACE), 0))
        return (front - (1 << 31)) << 32 | (Rolling(self.hash.view(U64)).spans(lo, hi) >> U64(32)).astype(np.int64)

    def spelled(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each token's begin) of some tokens."""
        size = self.size[which]
        at = np.concatenate(([0], np.cumsum(size)))
        flat = self.low.take(ranges(self.begin[which], self.begin[which] + size), mode="clip") if len(self.low) else np.zeros(at[-1], np.uint8)
        flat[at[1:] - 1] = np.where(self.hash[which] == END_TOKEN, END, SPACE)
        return flat, at


def uniques(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, some place of each, and where each element's value is among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.concatenate((np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]))
    at = np.empty(len(x), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], order[new], at


def found(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """searchsorted of many values in no order."""
    order = np.argsort(some)
    out = np.empty(len(some), dtype=np.int64)
    out[order] = np.searchsorted(x, some[order])
    return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of half-open intervals, one interval after the other."""
    some = hi > lo
    lo, hi = lo[some], hi[some]
    first = np.cumsum(hi - lo)
    out = np.ones(int(first[-1]) if len(first) else 0, dtype=np.int64)
    if len(out):
        out[0] = lo[0]
        out[first[:-1]] = lo[1:] - hi[:-1] + 1
    return np.cumsum(out, out=out)


def heads(size: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Booleans: the first some elements of spans of that size, one span after the other."""
    first = np.cumsum(size) - size
    turn = np.zeros(int(size.sum()) + 1, dtype=np.int8)
    on = some > 0
    turn[first[on]] += 1
    turn[(first + some)[on]] -= 1
    return np.cumsum(turn[:-1], dtype=np.int8).view(bool)


def before(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of two and three bytes before each; texts begin at begins, preceded by ends."""
    p = [np.full(len(flat), END, dtype=np.uint32) for _ in range(3)]
    for k in range(3):
        p[k][k + 1 :] = flat[: len(flat) - k - 1]
    for k in range(3):
        for late in range(k + 1):
            at = begins + late
            p[k][at[at < len(flat)]] = END
    # A text of one byte is followed by the next text, whose own beginning has been set above.
    two = p[1] << np.uint32(8) | p[0]
    three = ((p[2] << np.uint32(16) | two) * np.uint32(2654435761)) >> np.uint32(16)
    return two.astype(np.uint16), (three & np.uint32(BUCKETS - 1)).astype(np.uint16)


def _counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[at], np.diff(np.append(at, len(x)))


def binaries(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def packed(t: pa.Table) -> bytes:
    """A table as one compressed value, so that rows in order of their words share what their spellings share."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def unpacked(x: bytes) -> pa.Table:
    return pa.ipc.open_stream(x).read_all()


def counted(docs: DataFrame, tasks: int) -> DataFrame:
    """(kind, h, s, word, n, size) of docs (text, learn): distinct tokens (kind 0) with their spelling; cells of two (1) and three (2) bytes before a byte; passages (3) of anchors, s their key and size their bytes; n counts training texts."""

    def rows(kind: int, h: np.ndarray, s: np.ndarray | None, words: pa.Array | None, n: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
        words = pa.nulls(len(h), pa.binary()) if words is None else words
        s, size = (np.zeros(len(h), np.int64) if x is None else x for x in (s, size))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.astype(np.int64)), pa.array(s), words, pa.array(n.astype(np.int64)), pa.array(size.astype(np.int32))], names=["kind", "h", "s", "word", "n", "size"])

    def summed(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """Rows in order of their keys, and the keys."""
        key = mix64(mix64(t["h"].to_numpy().view(U64) * U64(4) + t["kind"].to_numpy().astype(U64)) + t["s"].to_numpy().view(U64))
        key, first, at = uniques(key)
        return t.take(pa.array(first)).set_column(4, "n", pa.array(np.bincount(at, t["n"].to_numpy(), len(first)).astype(np.int64))), key

    def whole(held: list[pa.Table]) -> pa.Table:
        """The tables as one, which alone is left of them."""
        t = pa.concat_tables(held).combine_chunks()
        held.clear()
        trim()
        return t

    def dealt(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t, key = summed(whole(held))
        cuts = [0, *(np.searchsorted(key, U64((k << 64) // tasks)) for k in range(1, tasks)), len(key)]
        some = [(k, packed(t.slice(int(lo), int(hi - lo)))) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["task", "rows"])

    def counts_of(data: np.ndarray, offsets: np.ndarray, learn: np.ndarray) -> pa.Table:
        t = Tokens(data, offsets)
        h, first, at = uniques(t.hash)
        taught = np.repeat(learn, np.diff(t.first))
        got = [rows(0, h, None, binaries(*t.spelled(first)), np.bincount(at, taught, len(h)))]
        if learn.any():
            flat, ends = t.spelled(np.flatnonzero(taught))
            own = np.diff(t.first)[learn]
            for kind, context in enumerate(before(flat, ends[np.cumsum(own) - own]), 1):
                cell, n = _counts(context.astype(np.uint32) << np.uint32(8) | flat)
                got.append(rows(kind, cell, None, None, n))
            h, lo, hi = t.anchors()
            on = taught[lo]
            h, lo, hi = h[on], lo[on], hi[on]
            long = np.concatenate(([0], np.cumsum(t.size)))
            got.append(rows(3, h, t.passage_keys(lo, hi), None, np.ones(len(h)), long[hi] - long[lo]))
        return pa.Table.from_batches(got)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text", PIECE):
                held.append(counts_of(data, offsets, part.column("learn").to_numpy(zero_copy_only=False).astype(bool)))
                if sum(t.num_rows for t in held) > 2_000_000:
                    yield from dealt(held)
        if held:
            yield from dealt(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(x) for b in batches for x in b.column("rows").to_pylist()]
        if held:
            yield from summed(whole(held))[0].combine_chunks().to_batches(100_000)

    kinds = "kind int, h long, s long, word binary, n long, size int"
    return docs.mapInArrow(lean(count), "task int, rows binary").repartitionById(tasks, "task").mapInArrow(lean(merge), kinds)


def passage_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, s, st) of the distinct rows wanted (h, s): the passage of that anchor and key in the texts (text)."""
    at = wanted.groupBy(F.expr(f"(s & {PLACES - 1}) >> 6").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits")).toArrow()  # at most PLACES / 64 rows
    places = np.zeros(PLACES >> 6, dtype=U64)
    places[at["k"].to_numpy()] = at["bits"].to_numpy().view(U64)
    sent = wanted.sparkSession.sparkContext.broadcast(places)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch, "text", PIECE):
                t = Tokens(data, offsets)
                h, lo, hi = t.anchors()
                s = t.passage_keys(lo, hi)
                on = np.flatnonzero(sent.value[(s & (PLACES - 1)) >> 6] >> (s & 63).view(U64) & U64(1))
                on = on[uniques(mix64(h[on].view(U64)) + s[on].view(U64))[1]]
                h, s, lo, hi = h[on], s[on], lo[on], hi[on]
                flat, ends = t.spelled(ranges(lo, hi))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), binaries(flat, ends[np.concatenate(([0], np.cumsum(hi - lo)))])], names=["h", "s", "st"])

    return texts.select("text").mapInArrow(lean(find), "h long, s long, st binary").join(wanted, ["h", "s"], "left_semi").groupBy("h", "s").agg(F.min("st").alias("st"))


def table_of(cell: np.ndarray, n: np.ndarray, code: Code, contexts: int) -> np.ndarray:
    """The stretched predictions of (context, node), from the counts of cells context << 8 | byte."""
    out = np.zeros(contexts << 8, dtype=np.int8)
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    for lo in range(0, contexts, 2048):
        a, b = np.searchsorted(cell, (lo << 8, (lo + 2048) << 8))
        of, at = code.bits(cell[a:b] & 255)
        place = ((cell[a:b] >> 8)[of] - lo << 8) + code.node[at]
        times, bit = n[a:b][of], code.bit[at]
        size = min(2048, contexts - lo) << 8
        out[lo << 8 : (lo << 8) + size] = stretched(np.bincount(place, times * bit, size), np.bincount(place, times * (1 - bit), size))
    return out


# ---------------------------------------------------------------- the vocabulary's branches


def cut(words: list[bytes], n: np.ndarray, borders: list[bytes]) -> dict[bytes, np.ndarray]:
    """How often each byte follows each beginning of the borders, within sorted words."""
    out: dict[bytes, np.ndarray] = {}
    for border in borders:
        lo, hi = 0, len(words)
        for d in range(len(border)):
            lo, hi = bisect_left(words, border[:d], lo, hi), bisect_right(words, border[:d], lo, hi, key=lambda w, d=d: w[:d])
            if lo == hi:
                break
            follows = np.frombuffer(b"".join(w[d : d + 1] for w in words[lo:hi]), dtype=np.uint8)
            out[border[:d]] = np.bincount(follows, n[lo:hi], 256)
    return out


def predictions(words: list[bytes], n: np.ndarray, code: Code, borders: list[bytes] = (), shared: dict[bytes, np.ndarray] | None = None, branched: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(stretched predictions of all bits of sorted words, where each word's begin). shared: what follows the beginnings that borders cut, over all ranges. branched is set to each word's bits that don't follow from its own count; if it is given, the others stay 0."""
    size = np.array([len(w) for w in words])
    at = np.concatenate(([0], np.cumsum(size)))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    bit_at = np.concatenate(([0], np.cumsum(code.size[flat])))
    out = np.zeros(bit_at[-1], dtype=np.int8)
    if branched is not None:
        branched[:] = np.diff(bit_at[at])
    alive, group, d = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    cuts = {0: b""} if shared else {}  # groups that borders cut, and their beginning
    while len(alive):
        byte = flat[at[alive] + d]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (byte[1:] != byte[:-1])))
        branch = np.cumsum(new) - 1
        of_group, of_byte, times = group[new], byte[new], np.bincount(branch, n[alive])
        more = []
        for g, beginning in cuts.items():
            mine = np.flatnonzero(of_group == g)
            follows = shared[beginning]
            times[mine] = follows[of_byte[mine]]
            rest = np.setdiff1d(np.flatnonzero(follows), of_byte[mine])  # in other ranges
            more.append((np.full(len(rest), g), rest.astype(np.uint8), follows[rest]))
        all_group, all_byte, all_times = (np.concatenate(x) for x in zip((of_group, of_byte, times), *more, strict=True))
        of, path = code.bits(all_byte)
        _, place = np.unique((all_group[of] << 8) + code.node[path], return_inverse=True)
        weight, bit = all_times[of], code.bit[path]
        st = stretched(np.bincount(place, weight * bit), np.bincount(place, weight * (1 - bit)))[place]
        long = code.size[all_byte]
        begin, many = (np.cumsum(long) - long)[branch], code.size[byte]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(bit_at[at[alive] + d], many) + step] = st[np.repeat(begin, many) + step]
        cuts = {int(k): cuts[g] + bytes([of_byte[k]]) for g in cuts for k in np.flatnonzero(of_group == g)}
        cuts = {k: x for k, x in cuts.items() if x in shared}
        d += 1
        lone = (np.bincount(branch)[branch] == 1) & ~np.isin(branch, list(cuts))
        k = alive[lone & (size[alive] > d)]  # the rest of words that no other shares
        if branched is not None:
            branched[k] = bit_at[at[k] + d] - bit_at[at[k]]
        else:
            rest = size[k] - d
            own = flat[np.arange(rest.sum()) + np.repeat(at[k] + d - (np.cumsum(rest) - rest), rest)]
            many = bit_at[at[k + 1]] - bit_at[at[k] + d]
            where = np.arange(many.sum()) + np.repeat(bit_at[at[k] + d] - (np.cumsum(many) - many), many)
            out[where] = np.where(code.bit[code.bits(own)[1]] == 1, 1, -1) * np.repeat(stretched(n[k], 0 * n[k]), many)
        on = ~lone & (size[alive] > d)
        alive, group = alive[on], branch[on]
    return out, bit_at[at]


def groups_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of batches that come sorted by their first columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(k).to_numpy() for k in range(columns)]
        cuts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in x])) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, batch.num_rows), strict=True):
            own = tuple(int(c[lo]) for c in x)
            if held and key != own:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(int(lo), int(hi - lo)))
    if held:
        yield key, pa.Table.from_batches(held)


def range_borders(vocabulary: DataFrame, types: int) -> list[bytes]:
    """Words at which the ranges of vocabulary (h, word) begin, but the first."""
    parts = 1 + types // RANGE
    some = vocabulary.where(F.pmod(F.xxhash64("h"), F.lit(max(1, types // (SAMPLED * parts)))) == 0).select(F.substring("word", 1, BORDER).alias("w")) if parts > 1 else None
    sample = sorted({bytes(r.w) for r in some.collect()}) if parts > 1 else []  # about SAMPLED for each range
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def parts_of(flat: np.ndarray, at: np.ndarray, borders: list[bytes]) -> np.ndarray:
    """The range of each word: how many borders aren't above it."""
    if not borders:
        return np.zeros(len(at) - 1, dtype=np.int64)
    size, front = np.diff(at), np.zeros(len(at) - 1, dtype=U64)
    for k in range(8):
        front = front << U64(8) | np.where(k < size, flat.take(at[:-1] + k, mode="clip"), 0).astype(U64)
    edge = np.array([int.from_bytes(b[:8].ljust(8, b"\0"), "big") for b in borders], dtype=U64)
    low, part = np.searchsorted(edge, front, side="left"), np.searchsorted(edge, front, side="right")
    for k in np.flatnonzero(low < part):  # the first letters are a border's
        part[k] = bisect_right(borders, flat[at[k] : at[k + 1]].tobytes())
    return part


def answered(vocabulary: DataFrame, asked: DataFrame, code: Code, borders: list[bytes]) -> DataFrame:
    """(block, st) of asked (part, block, h): packed (h, n, st) of the words of a block that lie in a range of vocabulary (h, word, n). st: the stretched predictions of a word's bits up to where no other shares its beginning."""
    spark = vocabulary.sparkSession
    sent = spark.sparkContext.broadcast((code, borders))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, borders = sent.value
        for batch in batches:
            part = [bisect_right(borders, w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", "h", "word", "n"])

    dealt = vocabulary.select("h", "word", "n").mapInArrow(lean(deal), "part int, h long, word binary, n long")
    none = F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("n")
    both = dealt.select("part", F.lit(-1).alias("block"), "h", "word", "n").unionByName(asked.select("part", "block", "h", *none))
    both = both.repartitionById(len(borders) + 1, "part").sortWithinPartitions("part", "block")

    def in_order(t: pa.Table) -> pa.Table:
        return t.take(pc.sort_indices(t["word"])).combine_chunks()

    def near(part: int) -> list[bytes]:
        borders = sent.value[1]
        return borders[max(0, part - 1) : part + 1]

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = in_order(pa.Table.from_batches(held))
            got = cut(t["word"].to_pylist(), t["n"].to_numpy(), sent.value[1])
            rows = [(x, b, int(v[b])) for x, v in got.items() for b in np.flatnonzero(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["beginning", "byte", "n"])

    shared: dict[bytes, np.ndarray] = {b[:d]: np.zeros(256) for b in borders for d in range(len(b))}
    if borders:  # at most BORDER beginnings for each border
        for r in vocabulary.select("word", "n").mapInArrow(lean(border), "beginning binary, byte int, n long").groupBy("beginning", "byte").agg(F.sum("n").alias("n")).collect():
            shared[bytes(r.beginning)][r.byte] = r.n
    cuts = spark.sparkContext.broadcast(shared)

    def spelled(part: int, t: pa.Table) -> tuple[np.ndarray, ...]:
        """(hashes in order, the word of each; n, predictions and where they begin of the words in order)."""
        t = in_order(t)
        beginnings = {b[:d] for b in near(part) for d in range(len(b))}
        own = np.zeros(t.num_rows, np.int64)
        flat, at = predictions(t["word"].to_pylist(), t["n"].to_numpy(), sent.value[0], near(part), {x: cuts.value[x] for x in beginnings}, own)
        h = t["h"].to_numpy()
        order = np.argsort(h)
        return h[order], order, t["n"].to_numpy(), flat[heads(np.diff(at), own)], np.concatenate(([0], np.cumsum(own)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = None, None
        for (p, block), t in groups_of(batches, 2):  # a range's words come before the blocks that ask for some
            if p != part:
                part, known = p, None
            if block < 0:
                known = spelled(p, t.select(["h", "word", "n"]))
                continue
            h, order, n, flat, at = known
            at_word = np.sort(order[np.searchsorted(h, t["h"].to_numpy())])
            h_of = np.empty(len(order), np.int64)
            h_of[order] = h
            size = at[at_word + 1] - at[at_word]
            st = binaries(flat[ranges(at[at_word], at[at_word + 1])], np.concatenate(([0], np.cumsum(size))))
            x = packed(pa.table([pa.array(h_of[at_word]), pa.array(n[at_word]), st], names=["h", "n", "st"]))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x], pa.binary())], names=["block", "st"])

    return both.mapInArrow(lean(answer), "block int, st binary")


# ---------------------------------------------------------------- mixing


class Mixer:
    """The tables that all tasks hold."""

    def __init__(self, code: Code, two: np.ndarray, three: np.ndarray):
        self.code, self.two, self.three = code, two, three
        deep = np.arange(len(code.node)) - np.repeat(code.first, code.size)
        self.step = code.node | deep << 8 | (code.bit.astype(np.int64) * 2 - 1 & 255) << 16  # of each place in node: its node, depth and sign by bytes
        self.right = np.concatenate((np.full((1, 256), -1), code.common)).astype(np.int8).ravel()  # bits of a byte that a guess gets right, by guess + 1 and byte

    def inputs(self, flat: np.ndarray, contexts: tuple[np.ndarray, ...], guess: np.ndarray, run: np.ndarray, trie: np.ndarray) -> np.ndarray:
        """(bits, 5) of spelled bytes: four stretched predictions that the bit is what it is, and the gate. guess: the byte that a passage predicts, or -1; run: 0 without a passage, 1, or 2 if it is far; trie: the predictions after the words so far."""
        x = np.empty((5, len(trie)), dtype=np.int8).T  # each input's values side by side
        done = 0
        for lo in range(0, len(flat), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            symbol, asked = flat[part], guess[part]
            long = self.code.size[symbol]
            right = self.right.take((asked.astype(np.int64) + 1) << 8 | symbol)
            path = self.code.first[symbol] - (np.cumsum(long) - long)  # modulo 2**16, which no code's paths reach
            of = np.repeat(right.view(np.uint8) | contexts[0][part].astype(np.int64) << 8 | run[part].astype(np.int64) << 25 | contexts[1][part].astype(np.int64) << 32 | path << 48, long)  # a bit's byte in one value, taken apart by its bytes
            step = self.step.take((of >> 48) + np.arange(len(of)) & 65535)
            right, ahead, deep, sign = of.view(np.int8)[::8], of.view(np.int8)[3::8], step.view(np.int8)[1::8], step.view(np.int8)[2::8].copy()
            node, to = step & 255, slice(done, done + len(of))
            np.multiply(self.two.take(of & 0xFFFF00 | node), sign, out=x[to, 0])
            np.multiply(self.three.take(of >> 24 & 0xFFFF00 | node), sign, out=x[to, 1])
            np.multiply(trie[to], sign, out=x[to, 2])
            left = right - deep
            np.multiply((left > 0).view(np.int8) - (left == 0).view(np.int8), np.int8(SURE), out=x[to, 3])
            np.add((left >= 0).view(np.int8) * ahead, trie[to] != 0, out=x[to, 4])
            done += len(of)
        return x


def passages(t: Tokens, flat: np.ndarray, at: np.ndarray, known: "Known") -> tuple[np.ndarray, np.ndarray]:
    """(guess, run) of all spelled bytes of t: see Mixer.inputs."""
    guess, run = np.full(len(flat), -1, dtype=np.int16), np.zeros(len(flat), dtype=np.int8)
    h, token, end = t.anchors()
    row = np.minimum(np.searchsorted(known.hash, h), max(len(known.hash) - 1, 0))
    on = np.flatnonzero(known.hash[row] == h) if len(known.hash) else np.zeros(0, np.int64)
    if len(on):  # texts that go on as the passage does hold its bytes
        same = known.n[row[on]] == t.passage_keys(token[on], end[on])
        lo, hi = at[token[on[same]]], at[end[on[same]]]
        where = ranges(lo, hi)
        guess[where] = flat[where]
        run[where] = 1 + (where - np.repeat(lo, hi - lo) >= FAR)
        on = on[~same]
    text_end = at[t.first[np.searchsorted(t.first, token[on], side="right")]]
    lo, begin = known.at[row[on]], at[token[on]]
    size = np.minimum(known.at[row[on] + 1] - lo, text_end - begin)
    on = np.flatnonzero(size > 0)
    lo, begin, size = lo[on], begin[on], size[on]
    if len(on):
        first = np.cumsum(size) - size
        said, where = known.st[ranges(lo, lo + size)].view(np.uint8), ranges(begin, begin + size)
        place = np.arange(len(said)) - np.repeat(first, size)
        wrong = np.minimum.reduceat(np.where(said == flat[where], 1 << 40, place), first)  # the first wrong byte is predicted too
        good = place <= np.repeat(wrong, size)
        guess[where[good]] = said[good]
        run[where[good]] = 1 + (place[good] >= FAR)
    return guess, run


def laid_out(x: np.ndarray, size: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Lays texts' inputs out in groups of bits, (groups, inputs, bits), which begin with each text; gives each text's first group."""
    x, steps = x.T, -(-size // GROUP)
    begin = np.cumsum(steps) - steps
    for to, lo, n in zip(begin.tolist(), (np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
        full, rest = divmod(n, GROUP)
        out[to : to + full] = x[:, lo : lo + full * GROUP].reshape(len(x), full, GROUP).transpose(1, 0, 2)
        if rest:
            out[to + full, :, :rest] = x[:, lo + full * GROUP : lo + n]
            out[to + full, :, rest:] = 0  # refines nothing
    return begin


def refined(wide: np.ndarray, begin: np.ndarray, size: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The natural logarithms of texts' probabilities. wide: inputs by groups of bits; begin: the first group of each text; size: bits of each; w: (texts, gates, inputs) weights, refined in place."""
    texts, gates, inputs = w.shape
    steps = -(-size // GROUP)
    order = np.argsort(-steps, kind="stable")  # those still being read stay in front
    gain = np.zeros(texts)
    places = np.arange(LANES)[:, None] * (gates * GROUP) + np.arange(GROUP)
    errors = np.zeros((LANES, gates, GROUP), dtype=np.float32)
    rate = np.float32(RATE / SCALE**2)
    for some in np.split(order, range(LANES, texts, LANES)):
        lanes = np.searchsorted(-steps[some], -np.arange(int(steps[some].max(initial=0))), side="left")  # texts that have a step
        own, at = w[some] * np.float32(-1 / SCALE), begin[some]
        costs = np.zeros((len(some), GROUP // 4))
        for step, m in enumerate(lanes.tolist()):
            part = wide[at[:m] + step]
            v = part[:, :inputs].astype(np.float32)
            place = np.multiply(part[:, inputs], GROUP, dtype=np.int64)
            place += places[:m]
            s = np.matmul(own[:m], v).take(place)  # minus the mixed prediction, of all gates, then of the bit's
            np.minimum(s, 12, out=s)
            np.maximum(s, -12, out=s)
            np.exp(s, out=s)
            s += 1
            np.divide(1, s, out=s)  # the bit's probability
            four = s[:, : GROUP // 2] * s[:, GROUP // 2 :]
            four = four[:, : GROUP // 4] * four[:, GROUP // 4 :]
            costs[:m] += np.log(four, out=four)
            s -= 1
            e = errors[:m]
            e.reshape(-1)[place] = s
            own[:m] += rate * np.matmul(e, v.transpose(0, 2, 1))
            e.fill(0)
        w[some] = own * np.float32(-SCALE)
        gain[some] = costs.sum(axis=1)
    return gain + np.log(2) * (steps * GROUP - size)  # places beyond a text's end count as bits of probability 1/2


def mixed(x: np.ndarray, size: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The natural logarithms of texts' probabilities. x: inputs of texts one after the other, size: bits of each; w: see refined."""
    wide = np.empty((int((-(-size // GROUP)).sum()), x.shape[1], GROUP), dtype=np.int8)
    return refined(wide, laid_out(x, size, wide), size, w)


def first_weights(texts: int) -> np.ndarray:
    return np.tile(np.array(WEIGHTS, dtype=np.float32), (texts, 1, 1))


class Known:
    """Counts and byte strings of a block's words or anchors, sorted by hash; of an anchor, n is the passage's key, and the bytes may be missing if no text of the block goes on otherwise."""

    def __init__(self, t: pa.Table):
        t = t.take(pc.sort_indices(t["h"])).combine_chunks()
        self.hash, self.n = t["h"].to_numpy(), t["n"].to_numpy()
        self.alone = stretched(np.maximum(self.n, 0).astype(np.float64), np.zeros(len(self.n)))
        st = t["st"].combine_chunks() if isinstance(t["st"], pa.ChunkedArray) else t["st"]
        st = pa.concat_arrays(st.chunks) if isinstance(st, pa.ChunkedArray) else st
        self.at = np.frombuffer(st.buffers()[1], dtype=np.int32, count=len(st) + 1 + st.offset)[st.offset :].astype(np.int64) if len(st) else np.zeros(1, np.int64)
        self.st = np.frombuffer(st.buffers()[2], dtype=np.int8) if st.buffers()[2] is not None and len(st) else np.zeros(0, np.int8)

    def tries(self, which: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predictions of all bits of words of so many bits, places of those of a word that is alone there: what they are if the bit is 1, else the opposite)."""
        lo, end = self.at[which], np.cumsum(long)
        rest = long - (self.at[which + 1] - lo)
        out = self.st.take(ranges(lo, lo + long), mode="clip") if len(self.st) else np.zeros(int(long.sum()), dtype=np.int8)
        alone = ranges(end - rest, end)
        out[alone] = np.repeat(self.alone[which], rest)
        return out, alone


def stretches(t: Tokens, which: np.ndarray, known: Known, anchored: Known, mixer: Mixer) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their inputs, bits of each) of each stretch of t. which: the row in known of each token; anchored: passages by anchor."""
    flat, at = t.spelled(np.arange(len(t.hash)))
    contexts = before(flat, at[t.first[:-1]])
    guess, run = passages(t, flat, at, anchored)
    for r in range(-(-int(np.diff(t.first).max(initial=0)) // STRETCH)):
        a = np.minimum(t.first[:-1] + r * STRETCH, t.first[1:])
        b = np.minimum(a + STRETCH, t.first[1:])
        on = np.flatnonzero(b > a)
        whole = r == 0 and (b == t.first[1:]).all()
        part = slice(None) if whole else ranges(at[a[on]], at[b[on]])
        own = slice(None) if whole else ranges(a[on], b[on])
        spelled = flat[part]
        bit_at = np.concatenate(([0], np.cumsum(mixer.code.size[spelled])))
        trie, alone = known.tries(which[own], np.diff(bit_at[np.concatenate(([0], np.cumsum(t.size[own])))]))
        x = mixer.inputs(spelled, tuple(c[part] for c in contexts), guess[part], run[part], trie)
        x[alone, 2] = trie[alone]
        yield on, x, np.diff(bit_at[np.concatenate(([0], np.cumsum(at[b[on]] - at[a[on]])))])


def text_costs(t: Tokens, which: np.ndarray, known: Known, anchored: Known, mixer: Mixer) -> np.ndarray:
    """The natural logarithm of each text's probability; see stretches."""
    texts = len(t.first) - 1
    w, gain = first_weights(texts), np.zeros(texts)
    for on, x, size in stretches(t, which, known, anchored, mixer):
        own = w[on]
        gain[on] += mixed(x, size, own)
        w[on] = own
    return gain


class Waiting:
    """Texts of several pieces, which are then read in step; what is said of each piece besides its score waits with them."""

    def __init__(self):
        self.wide = np.empty((HELD, 5, GROUP), dtype=np.int8)
        self.clear()

    def clear(self) -> None:
        self.used, self.begin, self.size, self.said = 0, [], [], []

    def fits(self, size: np.ndarray) -> bool:
        return self.used + int((-(-size // GROUP)).sum()) <= HELD

    def add(self, x: np.ndarray, size: np.ndarray, said: Callable[[np.ndarray], pa.RecordBatch]) -> None:
        self.begin.append(self.used + laid_out(x, size, self.wide[self.used :]))
        self.used += int((-(-size // GROUP)).sum())
        self.size.append(size)
        self.said.append(said)

    def scored(self) -> Iterator[pa.RecordBatch]:
        if self.said:
            size = np.concatenate(self.size)
            gain = refined(self.wide, np.concatenate(self.begin), size, first_weights(len(size)))
            for said, part in zip(self.said, np.split(gain, np.cumsum([len(x) for x in self.size])[:-1]), strict=True):
                yield said(part)
        self.clear()


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row, by a model of the rows for which ``learn`` holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).alias("text")
    counts = scratch.keep(counted(docs.select(text, F.coalesce(learn, F.lit(False)).alias("learn")), n))
    scratch.settle(2)
    cells = [counts.where(F.col("kind") == k).select("h", "n").toArrow() for k in (1, 2)]  # 2**24 at most of each
    cells = [(t["h"].to_numpy(), t["n"].to_numpy()) for t in cells]
    code = Code(np.bincount(cells[0][0] & 255, cells[0][1], 256))
    tables = [table_of(h, m, code, size) for (h, m), size in ((cells[0], 1 << 16), (cells[1], BUCKETS))]
    sent = spark.sparkContext.broadcast(Mixer(code, *tables))
    vocabulary = counts.where("kind = 0").select("h", "word", "n")
    all_tokens, distinct, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.count("*")).first()
    most = counts.where("kind = 3").groupBy("h").agg(F.max(F.struct("n", "size", "s")).alias("m"))
    best = scratch.keep(most.select("h", F.col("m.s").alias("best")))
    scratch.settle(2)
    borders = spark.sparkContext.broadcast(range_borders(vocabulary, types))

    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, volume // BLOCK, min(n, volume >> 18))
    parts = int(max(1, min(blocks, 4 * n)))
    d = docs.select(F.col(id_col).alias("id"), text).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # words and their ranges, anchors and their keys, of each piece

        def rows() -> pa.RecordBatch:
            h, part, anchor, key = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first, _ = uniques(h)
            part = part[first]
            order = np.argsort(part, kind="stable")
            by = np.argsort(anchor)
            anchor, key = anchor[by], key[by]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), anchor[1:] != anchor[:-1])))
            one = np.minimum.reduceat(key, first) == np.maximum.reduceat(key, first) if len(first) else np.zeros(0, bool)
            anchor, key = anchor[first], np.where(one, key[first], 0)  # 0: its texts go on in several ways
            at = pa.array(np.concatenate((part[order], key)), mask=np.concatenate((np.zeros(len(h), bool), key == 0)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), last, np.int32)), pa.array(np.repeat(np.arange(2, dtype=np.int32), (len(h), len(anchor)))), pa.array(np.concatenate((h[order], anchor))), at], names=["block", "kind", "h", "at"])

        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text", PIECE):
                block = part.column("block").to_numpy()
                t = Tokens(data, offsets)
                anchor, token, end = t.anchors()
                key = t.passage_keys(token, end)
                for b in np.unique(block):  # rows come in order of their blocks
                    if b != last and last is not None:
                        yield rows()
                        held = []
                    last = b
                    at = np.flatnonzero(block == b)
                    lo, hi = t.first[at[0]], t.first[at[-1] + 1]
                    new, first, _ = uniques(t.hash[lo:hi])
                    own = (token >= lo) & (token < hi)
                    held.append((new, parts_of(*t.spelled(lo + first), borders.value), anchor[own], key[own]))
        if last is not None:
            yield rows()

    asked = scratch.keep(d.repartitionById(parts, "block").sortWithinPartitions("block").mapInArrow(lean(ask), "block int, kind int, h long, at long"))
    scratch.settle(2)
    after = asked.where("kind = 1").select("block", "h", "at").join(best, "h").select("block", "h", "best", F.coalesce(F.col("at") != F.col("best"), F.lit(True)).alias("need"))
    after = scratch.keep(after)
    scratch.settle(2)
    said = scratch.keep(passage_bytes(docs.where(learn).select(text), after.where("need").select("h", F.col("best").alias("s")).distinct()))
    scratch.drop(2)
    scratch.settle(2)
    words = scratch.keep(answered(vocabulary, asked.where("kind = 0").select(F.col("at").cast("int").alias("part"), "block", "h"), code, borders.value))
    scratch.drop(1, 3)
    scratch.settle(2)
    none = [F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text")]
    nothing, no = F.lit(None).cast("binary").alias("st"), [F.lit(None).cast("long").alias(x) for x in ("h", "n")]
    known = words.select("block", F.lit(0).alias("kind"), *none, *no, "st")
    on = after.where("need").join(said.select("h", "st"), "h").select("block", F.lit(1).alias("kind"), *none, "h", F.col("best").alias("n"), "st")
    own = after.where("NOT need").select("block", F.lit(1).alias("kind"), *none, "h", F.col("best").alias("n"), nothing)
    both = known.unionByName(on).unionByName(own).unionByName(d.select("block", F.lit(2).alias("kind"), "id", "text", *no, nothing))
    both = both.repartitionById(parts, "block").sortWithinPartitions("block", "kind", F.octet_length("text"))  # texts of a size are read in step
    floor = np.log10(all_tokens + 0.5 * (distinct + 1))

    def scored(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, known: Known, anchored: Known, mixer: Mixer, waiting: Waiting) -> Iterator[pa.RecordBatch]:
        t = Tokens(data, offsets)
        which = found(known.hash, t.hash)
        own = known.n[which]
        size = np.add.reduceat(t.size, t.first[:-1])
        base = np.add.reduceat(np.log10(own + 0.5) - floor, t.first[:-1])
        ints = [np.diff(t.first), np.add.reduceat((own > 0).astype(np.int64), t.first[:-1])]
        ids = pa.concat_arrays([part.column("id")])

        def said(gain: np.ndarray) -> pa.RecordBatch:
            score = gain / np.log(10)
            return pa.RecordBatch.from_arrays([ids, *[pa.array(a.astype(np.int64)) for a in ints], pa.array(base), pa.array(score), pa.array(-score * np.log2(10) / size)], names=["id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

        if ints[0].max() > STRETCH or int(mixer.code.size[t.low].sum()) // GROUP > HELD // 2:  # long texts
            yield said(text_costs(t, which, known, anchored, mixer))
            return
        _, x, bits = next(stretches(t, which, known, anchored, mixer))
        if not waiting.fits(bits):
            yield from waiting.scored()
        waiting.add(x, bits, said)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, held, rows_of, known, waiting = sent.value, None, ([], []), None, Waiting()
        for batch in batches:
            block, what = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(what) != 0)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(block)), strict=True):
                if lo == hi:
                    continue
                rows = batch.slice(int(lo), int(hi - lo))
                if block[lo] != held:
                    held, rows_of, known = block[lo], ([], []), None
                if what[lo] < 2:
                    rows = rows.select(["h", "n", "st"])
                    rows_of[what[lo]].extend([pa.Table.from_batches([rows])] if what[lo] else map(unpacked, rows.column("st").to_pylist()))
                    continue
                if known is None:
                    empty = pa.Table.from_batches([rows.slice(0, 0).select(["h", "n", "st"])])
                    known = [Known(pa.concat_tables([x.cast(empty.schema) for x in (empty, *of)])) for of in rows_of]
                    rows_of = ([], [])
                for piece in text_blocks(rows, "text", PIECE >> 2):  # a bit takes some 50 bytes
                    yield from scored(*piece, *known, mixer, waiting)
        yield from waiting.scored()

    got = both.mapInArrow(lean(judge), f"id {kind}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return got.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(all_tokens)).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
