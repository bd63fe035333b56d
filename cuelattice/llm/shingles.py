"""Shingle sets of texts: their hashes, their SimHash, their similarity, and shards in which similar sets meet.

A shard is a block of ``ROWS`` least shingle hashes under one of ``SHARDS`` orders. Two sets of similarity ``s`` share at least one shard,
but for a chance of ``(1 - s**ROWS)**SHARDS``: 1.2e-7 at 0.8, less above.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
SIMILARITY = 0.8
SHARDS = 40
ROWS = 5
SEED = 42
_CHUNK = 4096
_U = np.uint64


def factors() -> tuple[np.ndarray, np.ndarray]:
    """What orders shingle hashes anew for each row of each shard key."""
    drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SHARDS * ROWS, 1), dtype=_U)
    return drawn[0] << _U(1) | _U(1), drawn[1]


def set_fingerprint(held: np.ndarray) -> int:
    """The SimHash of a set: bits that more than half of its hashes have."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(held), 1 << 15):
        total += np.unpackbits(held[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * total > len(held), bitorder="little").tobytes(), "little")


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles (white space and the case of A-Z do not count); never empty."""
    words = (text or b"").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, SEED)], _U)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), _U))


def shard_keys(held: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The signed keys of the shards that a set belongs to."""
    low = np.full(SHARDS * ROWS, ~_U(0))
    for lo in range(0, len(held), _CHUNK):
        h = (held[lo : lo + _CHUNK] ^ order[1]) * order[0]
        h ^= h >> _U(32)
        h *= _U(0xBF58476D1CE4E5B9)
        np.minimum(low, h.min(1), out=low)
    rows = low.reshape(SHARDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], _U).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a similarity of ``least`` or more; lengths that forbid it are told first."""
    return min(len(a), len(b)) / max(len(a), len(b)) >= least and similarity(a, b) >= least
