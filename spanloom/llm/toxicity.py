"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A text's words (bytes, A-Z lower-cased) are read in overlapping windows; each is compressed with either dictionary, and the difference of the two lengths tells on which side the window lies.
Lengths of whole dictionaries differ by chance more than by a few telling words, so training is contrastive: of the labelled texts only those words
are given to the dictionary trainer that recur in their own class (``LEAST`` of its texts) and are rare in the other (under ``RATIO`` of that share).  Both dictionaries are laid behind one common base
trained on ordinary text, which makes usual text cost the same on either side.

Calibration, on labelled texts that the dictionaries haven't seen: how often each difference occurs in windows of either class gives each
difference its log likelihood ratio; four summaries of a text's ratios are turned into a probability by a logistic curve.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` of each class, by order of a hash of the id.  Of a labelled text with more than ``RUNS`` * ``RUN`` words, that many runs are read, evenly spaced from its
first word to its last; the common base is trained on ``BASE_WINDOWS`` windows (about), picked by a hash among those of all ordinary texts.  Scoring reads every text whole; its memory is bounded by the longest text.  The model (a few kB) goes to the tasks with the plan; nothing is shuffled but ids of labels.

Defined results: null, empty and blank texts score like a text whose summaries are all 0; without labels of both classes every score is 0.5; repeated rows repeat their score; a null label or id is not learned from; labels that contradict each
other for an id count as toxic; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_blocks

SAMPLE, RUNS, RUN, BASE_WINDOWS = 3000, 512, 16, 60_000
WIDTH, STEP = 8, 4
LEAST, FEWEST, RATIO = 0.02, 5, 0.1
OWN, BASE = 1024, 4096
#: Differences of lengths are told apart between these.
LOW, HIGH = -10, 29
PUNCTUATION = b".,;:!?|\"'()[]"


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= WIDTH:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + WIDTH]) for i in range(0, len(words) - WIDTH + STEP, STEP)]


def thinned(text: str) -> str:
    """The text, or RUNS runs of RUN words, evenly spaced over all of it."""
    words = text.split()
    if len(words) <= RUNS * RUN:
        return text
    starts = np.linspace(0, len(words) - RUN, RUNS).astype(int)
    return " ".join(w for a in starts for w in words[a : a + RUN])


def compressor(content: bytes) -> zs.ZstdCompressor:
    how = zs.ZstdCompressionParameters(min_match=5, strategy=zs.STRATEGY_LAZY2, window_log=17, hash_log=14, chain_log=14, search_log=6, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The strings that zstandard's trainer selects; of too few samples for it, the samples."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zs.train_dictionary(size, samples, k=16, d=6, f=20, accel=1, split_point=1.0).as_bytes()[-size + 256 :]
    except zs.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    ratios: tuple[float, ...]
    curve: tuple[list[float], list[float], list[float]]

    def differences(self) -> "callable":
        a, b = compressor(self.ordinary).compress, compressor(self.toxic).compress

        def of(text: bytes) -> np.ndarray:
            w = windows(text)
            d = np.fromiter(map(len, map(a, w)), np.int64, len(w)) - np.fromiter(map(len, map(b, w)), np.int64, len(w))
            return np.clip(d, LOW, HIGH) - LOW

        return of

    def probability(self, each: list[np.ndarray]) -> np.ndarray:
        mean, scale, w = (np.array(x) for x in self.curve)
        z = (features(each, np.array(self.ratios)) - mean) / scale @ w[:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


CONSTANT = Model(b" " * 8, b" " * 8, (0.0,) * (HIGH - LOW + 1), ([0.0] * 4, [1.0] * 4, [0.0] * 5))


def features(each: list[np.ndarray], ratios: np.ndarray) -> np.ndarray:
    """Of each text's windows: the mean ratio, the share and (as a logarithm) the number of strong ones, and the mean of the three largest."""
    out = np.zeros((len(each), 4))
    for k, d in enumerate(each):
        if len(d):
            r = ratios[d]
            strong = np.maximum(r - 1, 0).sum()
            out[k] = r.mean(), strong / len(r), np.log1p(strong), np.sort(r)[-3:].sum() / 3
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Means, scales and weights (the last is the offset) of a logistic curve, by Newton's method with a slight pull to 0."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, pull = np.zeros(a.shape[1]), np.full(a.shape[1], 0.1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (p - y) + pull * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return mean.tolist(), scale.tolist(), w.tolist()


def unlike(rows: list[tuple[object, bytes, int]]) -> list[tuple[object, bytes, int]]:
    """The rows without near copies of earlier ones, whose words would recur without telling anything."""
    known: set[int] = set()
    kept = []
    for row in rows:
        words = row[1].lower().split()
        own = {hash(tuple(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        if 2 * len(own & known) < len(own):
            kept.append(row)
        known |= own
    return kept


def train(rows: list[tuple[object, bytes, int]]) -> Model:
    """The model of (id, text, label) rows."""
    rows = unlike(sorted(rows, key=lambda r: (str(r[0]), r[1])))
    teach = [r for r in rows if zlib.crc32(b"part %s" % str(r[0]).encode()) % 3]
    judge = [r for r in rows if not zlib.crc32(b"part %s" % str(r[0]).encode()) % 3]
    if len({r[2] for r in teach}) < 2 or len({r[2] for r in judge}) < 2:
        teach = judge = rows
    if len({r[2] for r in rows}) < 2:
        return CONSTANT
    words = {y: [[w.strip(PUNCTUATION) for w in t.lower().split()] for _, t, k in teach if k == y] for y in (0, 1)}
    share = {y: Counter(w for text in words[y] for w in set(text)) for y in (0, 1)}

    def telling(y: int) -> list[bytes]:
        own, other, n, m = share[y], share[1 - y], len(words[y]), len(words[1 - y])
        good = {w for w, c in own.items() if len(w) > 2 and c >= max(LEAST * n, FEWEST) and (other[w] + 0.5) / m < RATIO * c / n}
        lines = ([w for w in text if w in good] for text in words[y])
        return [b" " + b" ".join(line[i : i + WIDTH]) + b" " for line in lines for i in range(0, len(line), WIDTH)]

    part = min(1.0, BASE_WINDOWS / max(1, sum(map(len, words[0])) // STEP))
    base = dictionary([w for _, t, y in teach if not y for w in windows(t) if zlib.crc32(w) <= part * 0xFFFFFFFF], BASE)
    plain = Model(base + dictionary(telling(1), OWN), base + dictionary(telling(0), OWN), CONSTANT.ratios, CONSTANT.curve)
    of = plain.differences()
    seen = [(of(t), y) for _, t, y in judge]
    counts = {y: sum((np.bincount(d, minlength=HIGH - LOW + 1) for d, k in seen if k == y), np.zeros(HIGH - LOW + 1)) for y in (0, 1)}
    ratios = np.log((counts[1] + 1) / (counts[1].sum() + 1)) - np.log((counts[0] + 1) / (counts[0].sum() + 1))
    curve = logistic(features([d for d, _ in seen], ratios), np.array([y for _, y in seen]))
    return Model(plain.toxic, plain.ordinary, tuple(ratios.tolist()), curve)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """The model of labelled rows for which ``learn`` (a condition on id_col of labels) holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
        picked = some if picked is None else picked.unionByName(some)
    ids = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)  # 2 * SAMPLE at most
    sampled = docs.select(id_col, "text").where("text IS NOT NULL").join(F.broadcast(ids), id_col)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(1, "text", pa.array([thinned(t) for t in batch.column(1).to_pylist()], pa.string()))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sampled.select(id_col, "text", "_y").mapInArrow(thin, f"`{id_col}` {kind}, text string, _y int").collect()  # RUNS * RUN words of each at most
    return train([(r[0], r[1].encode(), r[2]) for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, score, predicted, windows) of every row, and the columns of keep."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.differences()
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "text", 1 << 22):
                raw = data.tobytes()
                each = [of(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                p = model.probability(each)
                own = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array([len(d) for d in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kinds] + own, names=[*kinds, "score", "predicted", "windows"])

    asked = [F.col(f"`{c}`") for c in dict.fromkeys((*kinds, "text"))]
    return docs.select(asked).mapInArrow(judge, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", score double, predicted int, windows long")
