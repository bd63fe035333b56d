"""Ratios of matching blocks of two texts, equal to those of ``difflib``, without its walk over every character for each block."""

from __future__ import annotations

import numpy as np

from ..operators.blocks import matched_tokens


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _rare_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """``(i, j, n)``: longest diagonal runs of equal characters that are not popular in ``b``."""
    kinds, at, count = np.unique(b, return_inverse=True, return_counts=True)
    rare = np.flatnonzero(count[at] <= len(b) // 100 + 1)
    rare = rare[np.argsort(b[rare], kind="stable")]
    first, last = np.searchsorted(b[rare], a, "left"), np.searchsorted(b[rare], a, "right")
    n = last - first
    i = np.repeat(np.arange(len(a)), n)
    j = rare[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    if not len(i):
        return []
    along = np.lexsort((i, j - i))
    i, j = i[along], j[along]
    new = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
    length = np.diff(np.append(new, len(i)))
    order = np.lexsort((j[new], i[new], -length))
    return list(zip(i[new][order].tolist(), j[new][order].tolist(), length[order].tolist(), strict=True))


def matched_characters(a: str, b: str) -> int:
    """Characters in the matching blocks that ``difflib.SequenceMatcher(None, a, b)`` finds.

    In a ``b`` of 200 characters or more, blocks are sought by those that are not popular, and then grown over any that are equal.
    """
    if len(b) < 200:
        return matched_tokens(_codes(a), _codes(b))
    # longest first, then by place: the first run that lies whole in a rectangle beats all after it of its length
    rectangles, hits = [(_rare_runs(_codes(a), _codes(b)), 0, len(a), 0, len(b))], 0
    while rectangles:
        runs, a0, a1, b0, b1 = rectangles.pop()
        best, kept = (0, -a0, -b0), []
        for run in runs:
            i, j, n = run
            if i >= a1 or j >= b1 or i + n <= a0 or j + n <= b0:
                continue
            skip = max(a0 - i, b0 - j, 0)
            left = min(n, a1 - i, b1 - j) - skip
            if left > 0:
                kept.append(run)
                best = max(best, (left, -(i + skip), -(j + skip)))
        size, x, y = best[0], -best[1], -best[2]
        while x > a0 and y > b0 and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < a1 and y + size < b1 and a[x + size] == b[y + size]:
            size += 1
        if size:
            hits += size
            rectangles += [(kept, p, q, r, s) for p, q, r, s in ((a0, x, b0, y), (x + size, a1, y + size, b1)) if p < q and r < s]
    return hits


def ratio(a: str, b: str) -> float:
    return 2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0
