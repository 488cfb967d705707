"""SetSketch registers: floor-log values of exponential minima, and the joint likelihood estimate of similarity.

Register i of a set is floor(1 - log_b(min x_i(e))) over its elements e, with x_i(e) exponential of rate a, cut to
0..q + 1. Minima make registers mergeable (the maximum of two sketches is the union's), and with b near 1 two
registers are equal with a probability near the Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

A, B, Q = 20.0, 1.001, (1 << 16) - 2
_LOG_B = np.log(B)


def multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(0, 2**32, m, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, m, dtype=np.uint32)


def registers(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """(sets, m) uint16 registers. elements: 64-bit hashes, set after set; starts: where each (non-empty) set begins."""
    low = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    mul, add = multipliers(m)
    least = np.empty((m, len(starts)), np.uint32)
    buffer = np.empty_like(low)
    for i in range(m):
        np.multiply(low, mul[i], out=buffer)
        np.add(buffer, add[i], out=buffer)
        # the multiplier leaves low bits weak; the order of the high bits decides
        np.minimum.reduceat(buffer, starts, out=least[i])
    return quantised((least.T.astype(np.float64) + 0.5) / 2.0**32)


def quantised(uniform: np.ndarray) -> np.ndarray:
    x = -np.log1p(-uniform) / A
    return np.clip(np.floor(1 - np.log(x) / _LOG_B), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def likely_similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 201) -> np.ndarray:
    """Maximum-likelihood Jaccard of pairs of sketches with known set sizes, over a grid of values."""
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / _LOG_B
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    score = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return j[np.arange(len(j)), score.argmax(1)]
