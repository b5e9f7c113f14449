"""Lattice kernels over Arrow batches.

Spark builds and groups the lattices (explode, broadcast join, groupBy) and
sums the results (groupBy); the dynamic programme over a batch of words runs
here.  The edges of all words of a batch are laid end to end and swept by
position: one numpy step handles the edges of *all* words that end (or
start) there, so the number of Python steps is the longest word's length, not
the number of words or edges.  Edges arrive as three parallel arrays per word,
sorted by (end, start).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


class Edges:
    """The edges of a batch of words: ``word``, ``start``, ``end``, ``lp``."""

    def __init__(self, starts, ends, lps, n):
        flat = lambda x, t: np.concatenate([np.asarray(v, t) for v in x]) if len(x) else np.zeros(0, t)
        self._lay([len(x) for x in starts], flat(starts, np.int64), flat(ends, np.int64), flat(lps, np.float64), n)

    @classmethod
    def flat(cls, size, start, end, lp, n) -> Edges:
        """From arrays that already lie end to end, ``size`` edges per word."""
        x = cls.__new__(cls)
        x._lay(size, start, end, lp, n)
        return x

    def _lay(self, size, start, end, lp, n) -> None:
        self.size, self.n = np.asarray(size, np.int64), np.asarray(n, np.int64)
        self.word = np.repeat(np.arange(len(self.size)), self.size)
        self.start, self.end, self.lp = start, end, lp
        self.width = int(self.n.max()) + 1 if len(self.n) else 1
        self.first = np.cumsum(self.size) - self.size

    def by(self, position: np.ndarray):
        """``(p, edges at p by word, first edge of each word there)`` for every
        position that has edges, ascending."""
        # the edges lie by word already; a stable sort of 16-bit numbers is a radix sort
        order = np.argsort(position.astype(np.uint16) if self.width <= 1 << 16 else position, kind="stable")
        cut = np.searchsorted(position[order], np.arange(self.width + 1))
        for p in range(self.width):
            at = order[cut[p]:cut[p + 1]]
            if len(at):
                w = self.word[at]
                yield p, at, np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))


def _log_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, first)
    base = np.where(np.isfinite(top), top, 0.0)
    spread = np.repeat(base, np.diff(np.append(first, len(values))))
    with np.errstate(divide="ignore"):
        return base + np.log(np.add.reduceat(np.exp(values - spread), first))


def posteriors(x: Edges, f: np.ndarray) -> np.ndarray:
    """Expected count of every edge, f * P(edge | word) (forward-backward)."""
    alpha = np.full((len(x.n), x.width), -np.inf)
    beta = alpha.copy()
    words = np.arange(len(x.n))
    alpha[:, 0] = 0.0
    beta[words, x.n] = 0.0
    for p, at, first in x.by(x.end):
        w = x.word[at]
        alpha[w[first], p] = _log_sum(alpha[w, x.start[at]] + x.lp[at], first)
    for p, at, first in reversed(list(x.by(x.start))):
        w = x.word[at]
        beta[w[first], p] = _log_sum(beta[w, x.end[at]] + x.lp[at], first)
    total = alpha[words, x.n]
    return f[x.word] * np.exp(alpha[x.word, x.start] + x.lp + beta[x.word, x.end] - total[x.word])


def _flat(steps: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges by word and place, and their number per word, from the steps of all words, last first (-1: none)."""
    table = np.array(steps[::-1], np.int64).reshape(len(steps), words).T
    on = table >= 0
    return table[on], on.sum(axis=1)


def _cut(x: Edges, edges: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Per word its edges, counted from its first."""
    return np.split((edges - np.repeat(x.first, size)).astype(np.int32), np.cumsum(size)[:-1]) if len(size) else []


def best_edges(x: Edges) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the best segmentations, by word and in text order, and their
    number per word; on a tie the edge with the earliest start (the longer piece) wins."""
    score = np.full((len(x.n), x.width), -np.inf)
    back = np.zeros((len(x.n), x.width), np.int64)
    score[:, 0] = 0.0
    for p, at, first in x.by(x.end):
        w = x.word[at]
        values = score[w, x.start[at]] + x.lp[at]
        top = np.maximum.reduceat(values, first)
        count = np.diff(np.append(first, len(at)))
        hit = np.flatnonzero(values == np.repeat(top, count))
        _, one = np.unique(np.repeat(np.arange(len(first)), count)[hit], return_index=True)
        score[w[first], p], back[w[first], p] = top, at[hit[one]]
    pos, words, steps = x.n.copy(), np.arange(len(x.n)), []
    while (pos > 0).any():
        edge = np.where(pos > 0, back[words, pos], -1)
        steps.append(edge)
        pos = np.where(pos > 0, x.start[edge], 0)
    return _flat(steps, len(x.n))


def best_paths(x: Edges) -> list[np.ndarray]:
    """Per word the indices of the edges of its best segmentation, as ``best_edges``."""
    return _cut(x, *best_edges(x))


def two_best_edges(x: Edges) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two best different segmentations (the second empty if there is
    none), each as in ``best_edges``."""
    words = np.arange(len(x.n))
    score = np.full((len(x.n), x.width, 2), -np.inf)
    back, before = np.zeros(score.shape, np.int64), np.zeros(score.shape, np.int64)
    score[:, 0, 0] = 0.0
    for p, at, _ in x.by(x.end):
        # every edge continues both paths to its start
        edge, rank = np.concatenate([at, at]), np.repeat([0, 1], len(at))
        value = score[x.word[edge], x.start[edge], rank] + x.lp[edge]
        there = np.isfinite(value)
        edge, rank, value = edge[there], rank[there], value[there]
        order = np.lexsort((rank, x.start[edge], -value, x.word[edge]))
        edge, rank, value = edge[order], rank[order], value[order]
        w = x.word[edge]
        new = np.concatenate([[True], w[1:] != w[:-1]])[:len(w)]
        second = np.concatenate([[False], new[:-1]])[:len(w)] & ~new
        for k, chosen in enumerate((new, second)):
            score[w[chosen], p, k], back[w[chosen], p, k], before[w[chosen], p, k] = value[chosen], edge[chosen], rank[chosen]
    out = [[], []]
    for k in (0, 1):
        pos = np.where(np.isfinite(score[words, x.n, k]), x.n, 0)
        rank, steps = np.full(len(x.n), k), []
        while (pos > 0).any():
            on = pos > 0
            edge = np.where(on, back[words, pos, rank], -1)
            rank = np.where(on, before[words, pos, rank], rank)
            steps.append(edge)
            pos = np.where(on, x.start[edge], 0)
        out[k] = _flat(steps, len(x.n))
    return out


def two_best_paths(x: Edges) -> list[list[np.ndarray]]:
    """Per word its two best segmentations, as indices of their edges."""
    return [list(pair) for pair in zip(*(_cut(x, *flat) for flat in two_best_edges(x)))]


@F.pandas_udf(ArrayType(IntegerType()))
def viterbi_path(starts: pd.Series, ends: pd.Series, lps: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(best_paths(Edges(starts, ends, lps, n)), index=n.index, dtype=object)
