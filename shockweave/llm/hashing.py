"""64-bit hashes of words and word windows over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: A seed for the byte table, odd multipliers, the finalizer's constants.
SEED = 20261
P = np.uint64(0x9E3779B97F4A7C13)
Q = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse up to ``n``, kept while they suffice."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        up = np.full(size, P, np.uint64)
        down = np.full(size, pow(int(P), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        if size > 1 << 22:  # a very long text: not kept
            return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _powers.update(up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: differences of one running sum of weighted bytes."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a space after every text, and where each text starts."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the caller drops those across texts."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total, weight, n = np.zeros(len(words) - size + 1, np.uint64), 1, len(words) - size + 1
    for k in range(size):
        weight = weight * int(Q) % (1 << 64)
        total += words[k : k + n] * np.uint64(weight)
    return mixed(total + np.uint64(size))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of ``size`` lower-cased words, sorted.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words
    is one shingle, its whole word sequence; one without words has none.
    """
    data, offsets = joined(texts)
    starts, ends = runs(~SPACE[data])
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    words = span_hashes(LOWER[data], starts, ends)
    shingles = windows(words, size)
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        else:
            out.append(windows(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
