"""String similarities without a built-in, as vectorised functions (0 to 100)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.shipping import ship_package


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word a character."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Share of characters in a longest common subsequence; 0 for two empty strings."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 0.0


def set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words, and the shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    one, two = (f"{shared} {rest}".strip() for rest in (only_x, only_y))
    return max(indel_ratio(one, two), *((indel_ratio(shared, s) for s in (one, two)) if shared else (0.0,)))


class Crowd:
    """Word sets whose :func:`set_ratio` with another set is asked for, all at once.

    Their sorted words lie side by side in one integer, each set in machine words of its
    own with a spare bit that stops its carry, so one pass over a text gives its longest
    common subsequence with every one of them."""

    def __init__(self, sets: list[frozenset[str]]):
        self.sets, texts = sets, [" ".join(sorted(s)) for s in sets]
        self.counts, self.lengths = np.array([len(s) for s in sets]), np.array([len(t) for t in texts])
        holders: dict[str, list[int]] = {}
        for n, own in enumerate(sets):
            for word in own:
                holders.setdefault(word, []).append(n)
        self.holders = {w: np.array(h) for w, h in holders.items()}
        words = self.lengths // 64 + 1
        self.starts = np.concatenate([[0], np.cumsum(words)[:-1]])
        self.size = int(words.sum()) * 8
        marks: dict[str, bytearray] = {}
        full = bytearray(self.size)
        for start, text in zip((self.starts * 64).tolist(), texts, strict=True):
            for at, char in enumerate(text, start):
                full[at >> 3] |= 1 << (at & 7)
                marks.setdefault(char, bytearray(self.size))[at >> 3] |= 1 << (at & 7)
        self.full = int.from_bytes(full, "little")
        self.marks = {c: int.from_bytes(m, "little") for c, m in marks.items()}

    def common(self, text: str) -> np.ndarray:
        """Lengths of the longest common subsequences of a text and the sorted words."""
        row = self.full
        for char in text:
            hit = row & self.marks.get(char, 0)
            if hit:
                row = (row + hit | row - hit) & self.full
        left = np.bitwise_count(np.frombuffer(row.to_bytes(self.size, "little"), np.uint64)).astype(np.int64)
        return self.lengths - np.add.reduceat(left, self.starts)

    def like(self, own: frozenset[str], least: float) -> list[int]:
        """Places of the sets whose ratio with ``own`` is at least ``least`` (over 0)."""
        known = [w for w in own if w in self.holders]
        at = np.concatenate([self.holders[w] for w in known]) if known else np.zeros(0, np.int64)
        weights = np.repeat([len(w) for w in known], [len(self.holders[w]) for w in known]) if known else None
        n, size = np.bincount(at, minlength=len(self.sets)), np.bincount(at, weights, len(self.sets))
        joined = lambda letters, words: letters + np.maximum(words - 1, 0)
        head, gap = joined(size, n), (n > 0).astype(int)
        a = joined(sum(map(len, own)) - size, len(own) - n)
        b = joined(self.lengths - np.maximum(self.counts - 1, 0) - size, self.counts - n)
        shorter = np.minimum(a, b)
        # the shared words alone decide: one set lies in the other, or nearly does
        found = (n > 0) & ((shorter == 0) | (200.0 * head >= least * (2 * head + 1 + shorter)))
        # what the rests must have in common besides the shared words and the blank
        need = least * (2 * (head + gap) + a + b) / 200.0 - head - gap - 1e-9
        open_ = ~found & (shorter >= need) & (shorter > 0)
        if open_.any():
            # parts of the words have no more in common than all of them
            text = " ".join(sorted(own))
            for i in np.flatnonzero(open_ & (self.common(text) >= need)).tolist():
                other = self.sets[i]
                found[i] = lcs_length(" ".join(sorted(own - other)), " ".join(sorted(other - own))) >= need[i]
        return np.flatnonzero(found).tolist()


@F.pandas_udf(T.DoubleType())
def _title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def _content_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def title_ratio(a, b):
    ship_package()
    return _title_ratio(a, b)


def content_ratio(a, b):
    ship_package()
    return _content_ratio(a, b)
