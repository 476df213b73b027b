"""Suffixes of a collection of short strings in order, built column by column.

Round t inserts the symbol at place t from the right of every string: the suffixes of length up to
t, which stand in order, are dealt to the symbols that precede them, in one stable pass over the
collection's Burrows-Wheeler transform. The common prefix of two new neighbours is one more than the
least common prefix between the places that they came from. Each round reads the columns of the round
before from front to back and writes new ones; columns beyond ``IN_MEMORY`` entries are files.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries of a column that stay in memory; longer columns are files in the task's temporary folder.
IN_MEMORY = 1 << 22


def _column(n: int, kind: type) -> np.ndarray:
    if n <= IN_MEMORY:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as file:  # its space is freed with the mapping
        return np.memmap(file, kind, "w+", shape=(n,))


def _least_between(lcp: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. z]) for each pair a < z."""
    out = np.empty(len(a), np.uint8)
    level = np.frexp((z - a).astype(np.float64))[1].astype(np.uint8) - 1
    cur, j = lcp, 0
    top = int(level.max(initial=0))
    while True:
        at = np.flatnonzero(level == j)
        if len(at):
            out[at] = np.minimum(cur[a[at] + 1], cur[z[at] - (1 << j) + 1])
        if j == top:
            return out
        cur = np.minimum(cur[: -(1 << j)], cur[1 << j :])
        j += 1


def suffix_order(data: np.ndarray, lens: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings (``data``: their bytes one after another) in order: string, length, and
    the common prefix with the suffix before, counted up to ``cap`` (below 255)."""
    k = len(lens)
    ends = np.cumsum(lens)
    text, size, lcp = np.arange(k, dtype=np.int32), np.zeros(k, np.uint16), np.zeros(k, np.uint8)
    for _ in range(int(lens.max(initial=0))):
        at = np.flatnonzero(size < lens[text])
        bwt = data[ends[text[at]] - 1 - size[at]]
        order = np.argsort(bwt, kind="stable")
        at, bwt = at[order], bwt[order]
        same = np.flatnonzero(bwt[1:] == bwt[:-1])
        n = k + len(at)
        new_text, new_size, new_lcp = _column(n, np.int32), _column(n, np.uint16), _column(n, np.uint8)
        new_text[:k], new_size[:k], new_lcp[:] = np.arange(k), 0, 0
        new_text[k:], new_size[k:] = text[at], size[at] + np.uint16(1)
        new_lcp[k + 1 + same] = np.minimum(_least_between(lcp, at[same], at[same + 1]), cap - 1) + 1
        text, size, lcp = new_text, new_size, new_lcp
    return text, size, lcp
