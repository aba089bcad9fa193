"""How long a stock lasts: a small numpy helper for a batch of elements."""

from __future__ import annotations

import math

import numpy as np


def depletion_times(consumption: np.ndarray, stock: float, seed: int, paths: int = 600, horizon: int = 400, cycle: int = 7) -> tuple[float, float, float]:
    """10, 50 and 90 % points of the periods until a stock is used up, over resampled consumption; by place in the cycle from
    three cycles on. Infinite where it lasts beyond the horizon; the seed belongs to the element. Cycles are drawn one after
    the other until every path's stock is gone."""
    if stock <= 0:
        return 0.0, 0.0, 0.0
    if len(consumption) == 0 or consumption.sum() <= 0:
        return (math.inf,) * 3
    rng, n = np.random.default_rng(seed), len(consumption)
    pools = [consumption[(n + k) % cycle :: cycle] for k in range(cycle)] if n >= 3 * cycle else [consumption] * cycle
    left, times = np.full(paths, float(stock)), np.full(paths, np.inf)
    for start in range(0, horizon, cycle):
        draws = np.stack([rng.choice(p, paths) for p in pools[: horizon - start]], axis=1)
        after = left[:, None] - np.cumsum(draws, axis=1)
        gone = (after <= 0) & np.isinf(times)[:, None]
        hit = np.flatnonzero(gone.any(axis=1))
        at = gone[hit].argmax(axis=1)
        before = np.where(at > 0, after[hit, np.maximum(at - 1, 0)], left[hit])
        times[hit] = start + at + before / np.maximum(draws[hit, at], 1e-12)
        left = after[:, -1]
        if np.isfinite(times).all():
            break
    return tuple(float(np.quantile(times, q, method="inverted_cdf")) for q in (0.1, 0.5, 0.9))
