"""Anchors of byte texts: positions that equal strings of a given length choose alike."""

from __future__ import annotations

import numpy as np

MUL = 0x9E3779B97F4A7C15
#: Values that are worked on at a time, so that they stay in a core's cache.
PART = 1 << 14


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes (1 or more) of every run of k bytes (k at most 63)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > PART:
        out = np.empty(n, np.uint64)
        for i in range(0, n, PART):
            out[i : i + PART] = grams(data[i : i + PART + k - 1], k)
        return out
    power, size, have, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if have is None:
                have, done = power, size
            else:  # the run of done bytes, then the one of size
                m = min(len(have), len(power) - done)
                have = have[:m] * np.uint64(pow(MUL, size, 1 << 64)) + power[done : done + m]
                done += size
        if done == k:
            break
        power = power[:-size] * np.uint64(pow(MUL, size, 1 << 64)) + power[size:]
        size *= 2
    h = have[:n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of w values."""
    if (n := len(x) - w + 1) > PART:
        out = np.empty(n, x.dtype)
        for i in range(0, n, PART):
            out[i : i + PART] = sliding(x[i : i + PART + w - 1], w, pick)
        return out
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-byte runs that are least by hash among some length bytes inside one text, and their hashes.

    data holds the texts [starts, ends). Equal strings of length bytes mark the same runs in them, all of a tie.
    """
    w = length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(data, k)
    least = sliding(h, w, np.minimum)
    ok = np.zeros(len(data) + 1, np.int32)
    some = ends - starts >= length
    np.add.at(ok, starts[some], 1)
    np.add.at(ok, ends[some] - length + 1, -1)
    least[np.cumsum(ok)[: len(least)] == 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]
