"""Many queries scored together: an order that brings like ones together, and stretches of their postings."""

from __future__ import annotations

import numpy as np

DENSE_LISTS, DENSE_CELLS, CHUNK, SHARED = 1024, 1 << 23, 128, 6  # longest lists that go into a shard's matrix, its cells at most, queries at a time, and how many of them have to share a list
SUMMED = 1.0001  # more than single-precision sums of DENSE_LISTS impacts can be short by
AT_ONCE = 1 << 21  # postings at a time


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0]-1, first[1] .. last[1]-1, and so on."""
    n = last - first
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - ends + n, n)


def parts(n: np.ndarray) -> list[slice]:
    """Stretches of the counts ``n`` of at most about ``AT_ONCE`` in all."""
    part = np.cumsum(n) // AT_ONCE
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist() if len(n) else []
    return [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]


def like_each_other(edge: np.ndarray, terms: np.ndarray, weights: np.ndarray, common: int = 256) -> np.ndarray:
    """An order of the queries that has those of like lengths and, among them, of like common words together; it changes what a
    chunk of them shares, not what is found."""
    size = np.diff(edge)
    length = np.log2(np.maximum(size, 1)).round()
    if not len(terms):
        return np.arange(len(size))
    weight = np.full(terms.max() + 1, np.inf)
    weight[terms] = weights
    place = np.full(len(weight), -1)
    low = np.argsort(weight, kind="stable")[:common]
    place[low] = np.arange(len(low))
    row, column = np.repeat(np.arange(len(size)), size), place[terms]
    has = np.zeros((len(size), len(low)), np.float32)
    has[row[column >= 0], column[column >= 0]] = 1
    has /= np.maximum(np.sqrt(has.sum(1, keepdims=True)), 1)
    has -= has.mean(0)
    axis = np.ones(len(low), np.float32)
    for _ in range(12):  # towards the direction in which they differ most
        axis = has.T @ (has @ axis)
        axis /= max(float(np.linalg.norm(axis)), 1e-9)
    return np.lexsort((has @ axis, length))
