"""SetSketch registers: exponentially spaced minima, truncated to whole powers of a base.

Every element gives rising points of a Poisson process, dealt to registers without replacement, and a register keeps
its least point x, stored as floor(1 - log_b(x)). So a register of a union is the greater of two registers, and
two registers agree with about the probability of the sets' Jaccard similarity. (Ertl, SetSketch: Filling the Gap
between MinHash and HyperLogLog, VLDB 2021.)
"""

from __future__ import annotations

import numpy as np

from sievegrid.llm.textvec import U, mix

REGISTERS = 128
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1


def registers(values: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """uint16 registers of each set; values[bounds[i]:bounds[i + 1]] are set i. m is a power of two.

    Elements stop once their next point is beyond every register of their set, so large sets cost about one point an element.
    """
    n = len(bounds) - 1
    least = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    seed = mix(values ^ U(0xD1B54A32D192ED03))
    place = (seed & U(m - 1)).astype(np.int64)
    step = ((seed >> U(20)) & U(m - 1)).astype(np.int64) | 1
    x = np.zeros(len(values))
    for j in range(m):
        u = ((mix(seed + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
        x = x - np.log(u) / (m - j)
        np.minimum.at(least, owner * m + place, x)
        limit = least.reshape(n, m).max(axis=1)
        active = x < limit[owner]
        if not active.any():
            break
        owner, seed, place, step, x = owner[active], seed[active], place[active], step[active], x[active]
        place = (place + step) & (m - 1)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, TOP).astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def joint_fit(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """fit_counts() of pairs of registers."""
    more, less = (first > second).sum(-1).astype(float), (first < second).sum(-1).astype(float)
    return fit_counts(more, less, first.shape[-1] - more - less, n_first, n_second, threshold)


def fit_counts(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarity of greatest likelihood, its log-likelihood above that of the threshold), for known set sizes.

    The joint likelihood of how many registers are greater, less and equal has one maximum in the similarity.
    """
    total = np.maximum(n_first + n_second, 1).astype(float)
    u, v = n_first / total, n_second / total
    top = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    low, high = np.zeros_like(top), top.copy()
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = _log_likelihood(a, u, v, more, less, same) < _log_likelihood(b, u, v, more, less, same)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    best = (low + high) / 2
    at = _log_likelihood(best, u, v, more, less, same) - _log_likelihood(np.minimum(np.full_like(top, threshold), top), u, v, more, less, same)
    return best, at


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers, the band's number mixed in."""
    n, m = regs.shape
    parts = regs.reshape(n, m // rows, rows).astype(U)
    key = np.broadcast_to(mix(np.arange(m // rows, dtype=U) + U(7)), (n, m // rows)).copy()
    for k in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)
