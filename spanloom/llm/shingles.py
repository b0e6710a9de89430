"""Sets of word shingles of texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from spanloom.llm.common import TO_LOWER, U64, Rolling, mix64, words_of

_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64)) | U64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in data, with repeats, and where each text's begin (one more entry at the end).

    A-Z are lower-cased; words are runs of bytes other than the space and 0x09 to 0x0D. A text with fewer words than width, but some, has one shingle: all its words.
    """
    data = TO_LOWER[data]
    starts, ends, first = words_of(data, offsets)
    n = np.diff(first)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(n) + 1, np.int64)
    words = Rolling(data).spans(starts, ends)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][text] + (np.arange(at[-1]) - at[:-1][text])
    size = np.minimum(n, width)[text]
    out = size.astype(U64)
    for k in range(width):
        more = k < size
        out += np.where(more, words[np.minimum(begin + k, len(words) - 1)] * _MULTIPLIERS[k], U64(0))
    return mix64(out), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    hashes, at = shingle_hashes(data, offsets, width)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, of sets that aren't empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
