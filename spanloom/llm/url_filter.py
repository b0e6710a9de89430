"""URL filters: a bit-parallel automaton for glob rules (extended Shift-And).

Every rule is a glob over the canonical URL ``"." + host + path``: ``*`` matches any characters but ``/``, ``**`` any
characters, ``?`` one byte that isn't ``/``.  The states of all rules are packed side by side into 64-bit words; one step per
byte advances every rule of every URL of a batch at once:

    D = ((D << 1) & match[byte]) | (D & loop[byte])

where ``loop`` holds the states before a star.  Carries cross words, so the number of rules has no bound but memory
(one bit for each byte of each rule).

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the default verdict;
repeated rows are judged one by one; an empty table gives an empty result; other columns are dropped, also when
their names clash (``id_col`` and ``url_col`` name the two that count).  If several rules fit, the longest (in bytes of host and path) wins,
then the earliest.  A rule's path must start the URL's path, so ``net/`` does not fit ``http://a.net?x``, whose path is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import U64, lower_ascii, text_blocks

SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    name: str
    glob: str
    verdict: str
    length: int

    @staticmethod
    def of(host_and_path: str, verdict: str) -> "Rule":
        """The rule of a host with all its subdomains and a path prefix, written like ``example.net/en/``."""
        host, slash, path = host_and_path.partition("/")
        return Rule(host_and_path, f"*.{host}{slash}{path}**", verdict, len(host_and_path.encode()))


class Automaton:
    """match and loop: for each byte, the states it leads to and those that it may stay in; words of 64 states."""

    def __init__(self, globs: list[str]):
        states: list[tuple[int, int]] = []  # (kind of byte that leads here, kind of loop); kinds over 255 are classes
        self.starts, self.accepts = [], []
        for glob in globs:
            raw, i, first = glob.encode(), 0, len(states)
            states.append((-1, 0))
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    states[-1] = (states[-1][0], 2)
                    i += 2
                elif raw[i : i + 1] == b"*":
                    states[-1] = (states[-1][0], max(states[-1][1], 1))
                    i += 1
                else:
                    states.append((256 if raw[i : i + 1] == b"?" else raw[i], 0))
                    i += 1
            self.starts.append(first)
            self.accepts.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.match = np.zeros((256, self.words), dtype=U64)
        self.loop = np.zeros((256, self.words), dtype=U64)
        self.start = np.zeros(self.words, dtype=U64)
        for k, (lead, loop) in enumerate(states):
            word, bit = k // 64, U64(1) << U64(k % 64)
            if lead >= 0:
                rows = np.array([c for c in range(256) if c != SLASH]) if lead == 256 else lead
                self.match[rows, word] |= bit
            if loop:
                rows = np.arange(256) if loop == 2 else np.array([c for c in range(256) if c != SLASH])
                self.loop[rows, word] |= bit
        for k in self.starts:
            self.start[k // 64] |= U64(1) << U64(k % 64)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, rules) booleans: which globs match which whole text."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")  # those still being read stay in front
        begin, size = offsets[:-1][order], size[order]
        d = np.repeat(self.start[None, :], len(order), axis=0)
        for step in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -step, side="left"))  # texts longer than step
            byte = data[begin[:n] + step]
            now = d[:n]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            d[:n] = (moved & self.match[byte]) | (now & self.loop[byte])
        out = np.empty((len(order), len(self.accepts)), dtype=bool)
        for j, k in enumerate(self.accepts):
            out[order, j] = (d[:, k // 64] >> U64(k % 64)) & U64(1) != 0
        return out


def canonical(url):
    """Columns of a URL: host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    bare = F.split(rest, "[?#]", 2)[0]
    slash = F.locate("/", bare)
    host = F.when(slash > 0, F.substr(bare, F.lit(1), slash - 1)).otherwise(bare)
    path = F.when(slash > 0, F.substr(bare, slash)).otherwise(F.lit(""))
    return lower_ascii(host), path


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row. See the module's text for defined results."""
    ranked = sorted(range(len(rules)), key=lambda k: (-rules[k].length, k))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in rules])
        names = np.array([r.name for r in rules] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in rules] + [default], dtype=object)
        for batch in batches:
            for part, data, offsets in text_blocks(batch, "_canonical"):
                hit = automaton.run(data, offsets)
                best = np.full(len(hit), len(rules))
                for k in reversed(ranked):
                    best[hit[:, k]] = k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                    names=[id_col, "host", "path", "rule", "verdict"],
                )

    host, path = canonical(F.col(url_col))
    kind = pages.schema[id_col].dataType.simpleString()
    asked = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("_canonical", F.concat(F.lit("."), "host", "path"))
    return asked.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
