"""Token counts by offset-mapped attribution.

A whole document is encoded once, with a public byte-level vocabulary.  Tokens of such a vocabulary spell the text's bytes one after the other, so the running sum
of their lengths gives every token's span; the spans are joined to the sorted spans of the document's sections (an interval join by binary search), and a
token that crosses a border is allotted by rule:

* ``start``: to the section that holds its first byte,
* ``most``: to the section that holds most of its bytes, the earlier on ties,
* ``share``: to every section it touches, by its share of bytes.

``most`` is the default.  Sections are the lines of a text, each with its line feed, or the named fields of a record, one after the other with a line feed between (which belongs to the earlier one).

Defined results: null and empty texts or fields have no token and are one empty section; texts of any length are encoded whole; rows are encoded one by one, so repeated
rows repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_blocks

RULES = ("start", "most", "share")
LF = 10


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoding and the byte length of each of its tokens; read once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    lengths[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def allot(ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ends: where each token ends; borders: where each section ends, the last where the text does."""
    if not len(ends):
        return np.zeros(len(borders))
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(borders, starts, side="right")
    if rule == "start":
        return np.bincount(first, minlength=len(borders)).astype(float)
    last = np.searchsorted(borders, ends - 1, side="right")
    inner = first == last
    out = np.bincount(first[inner], minlength=len(borders)).astype(float)
    for s, e, i, j in zip(starts[~inner], ends[~inner], first[~inner], last[~inner], strict=True):
        cut = np.concatenate(([s], borders[i:j], [e]))
        held = np.diff(cut)
        if rule == "most":
            out[i + int(np.argmax(held))] += 1
        else:
            out[i : j + 1] += held / (e - s)
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] | None = None, rule: str = "most", path: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, n_crossing, section_bytes, section_tokens): the last two are arrays by section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary()
    by_field = fields is not None
    texts = F.coalesce(F.col("text"), F.lit("")) if not by_field else F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    sizes = F.array(*[F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields]) if by_field else F.lit(None).cast("array<int>")
    kind = docs.schema[id_col].dataType.simpleString()

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(path)
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "_text", 1 << 22):
                raw, rows = data.tobytes(), []
                given = part.column("_sizes").to_pylist() if by_field else None
                for k in range(part.num_rows):
                    body = raw[offsets[k] : offsets[k + 1]]
                    ids = encoding.encode_ordinary(body.decode())
                    ends = np.cumsum(lengths[np.asarray(ids, dtype=np.int64)])
                    if by_field:
                        borders = np.cumsum(np.asarray(given[k]) + 1)
                        borders[-1] -= 1
                    else:
                        feeds = np.flatnonzero(data[offsets[k] : offsets[k + 1]] == LF) + 1
                        borders = feeds if len(feeds) and feeds[-1] == len(body) else np.append(feeds, len(body))
                    got = allot(ends, borders, rule)
                    crossing = int(np.count_nonzero(~np.isin(borders[:-1], ends))) if len(ids) else 0
                    rows.append((len(body), len(ids), crossing, np.diff(borders, prepend=0), got))
                out = [part.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_bytes", "n_tokens", "n_crossing", "section_bytes", "section_tokens"])

    asked = docs.select(id_col, texts.alias("_text"), sizes.alias("_sizes"))
    return asked.mapInArrow(attribute, f"`{id_col}` {kind}, n_bytes long, n_tokens long, n_crossing long, section_bytes array<long>, section_tokens array<double>")
