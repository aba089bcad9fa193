"""Kaplan-Meier within one block of a curve's spans, in numpy: the estimate (resample 0) and all resamples side by side.

A block is a run of a curve's spans in order of their days. ``after`` is who is at risk once it's over, ``more`` the events of its
last time in later blocks, ``begun`` whether its first time began in an earlier one (which then has that time's step), and
``start`` the survival before it; none of them where the block is the whole curve."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Cells of spans and resamples that are held at once.
CELLS = 100_000
#: Shares of a Poisson count of mean 1 that are at most 0, 1, 2, ... 8.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402)
_BITS = 53
_ABOVE = [np.uint64(int(p * (1 << _BITS))) for p in POISSON]
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Block(NamedTuple):
    days: np.ndarray
    hash: np.ndarray
    event: np.ndarray
    after: np.ndarray | None = None
    more: np.ndarray | None = None
    begun: bool = False
    start: np.ndarray | None = None


def hashed_on(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """XXH64 of whole numbers of four bytes with the seeds ``h``: how ``F.xxhash64`` goes on from the columns before."""
    h = (h + (_P5 + np.uint64(4))) ^ (values.astype(np.uint32).astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def weights(hashes: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """``lifetimes.resample_weight`` of entities, from the ``F.xxhash64`` of each, in each resample: a row an entity."""
    with np.errstate(over="ignore"):
        h = hashed_on(hashes.astype(np.int64).view(np.uint64)[:, None], np.asarray(resamples)[None, :])
        low = hashed_on(h, np.array([seed])) & np.uint64((1 << _BITS) - 1)
    n = np.zeros(low.shape, np.uint8)
    for above in _ABOVE:
        n += low > above
    n[:, np.asarray(resamples) == 0] = 1
    return n


def _slices(block: Block, resamples: int, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, CELLS // max(1, len(block.days)))
    for low in range(0, resamples + 1, step):
        cols = slice(low, min(low + step, resamples + 1))
        yield cols, weights(block.hash, np.arange(cols.start, cols.stop), seed)


def _first_rows(block: Block) -> np.ndarray:
    return np.flatnonzero(np.r_[True, block.days[1:] != block.days[:-1]])


def sums(block: Block, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each resample, the block's spans, and the events of its first time."""
    n, head = np.zeros(resamples + 1), np.zeros(resamples + 1)
    first = (block.days == block.days[0]) & block.event
    for cols, w in _slices(block, resamples, seed):
        n[cols], head[cols] = w.sum(axis=0, dtype=float), w[first].sum(axis=0, dtype=float)
    return n, head


def survivals(block: Block, resamples: int, seed: int, places: np.ndarray | None = None) -> np.ndarray:
    """Survival from each of the block's times on (or those at ``places``), a column a resample."""
    rows = _first_rows(block)
    out = np.empty((len(rows) if places is None else len(places), resamples + 1))
    for cols, w in _slices(block, resamples, seed):
        gone = w * block.event[:, None]
        n, e = (x.astype(float) if len(rows) == len(x) else np.add.reduceat(x, rows, axis=0, dtype=float) for x in (w, gone))
        risk = np.cumsum(n[::-1], axis=0)[::-1]
        if block.after is not None:
            risk = risk + block.after[cols]
        if block.more is not None:
            e[-1] += block.more[cols]
        factor = np.where(e > 0, 1 - e / np.where(risk > 0, risk, 1.0), 1.0)
        if block.begun:
            factor[0] = 1.0
        s = np.cumprod(factor, axis=0) * (1.0 if block.start is None else block.start[cols])
        out[:, cols] = np.maximum(s if places is None else s[places], 0.0)
    return out


def at_risk(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's times, and how many spans of the estimate last as long or longer, its later blocks' too."""
    rows = _first_rows(block)
    later = 0.0 if block.after is None else block.after[0]
    return block.days[rows], len(block.days) - rows + later


def ticks(values: np.ndarray) -> np.ndarray:
    """Values to twelve places, as ``survival.at_or_before`` compares them."""
    return np.round(np.asarray(values, float) * 1e12)


def survival_at(block: Block, days: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Survival of all resamples at each of ``days``, none of which lies before the block."""
    times = block.days[_first_rows(block)]
    return survivals(block, resamples, seed, np.maximum(np.searchsorted(ticks(times), ticks(days), side="right") - 1, 0))


def first_at_most(block: Block, goals: np.ndarray) -> np.ndarray:
    """The first time from which the survival of the estimate is at most each goal; not a number where it stays above."""
    times, s = block.days[_first_rows(block)], survivals(block, 0, 0)[:, 0]
    k = np.searchsorted(-ticks(s), -ticks(goals), side="left")
    return np.where(k < len(times), times[np.minimum(k, len(times) - 1)], np.nan)


def band(values: np.ndarray, low: float = 0.1, high: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles by linear interpolation over the known values of each row but its first; of a lone estimate, itself."""
    if values.shape[1] == 1:
        return values[:, 0], values[:, 0]
    others = np.sort(values[:, 1:], axis=1)  # unknown ones last
    n = (~np.isnan(others)).sum(axis=1)

    def at(share: float) -> np.ndarray:
        place = np.maximum(n - 1, 0) * share
        below, above = (np.take_along_axis(others, f(place).astype(int)[:, None], axis=1)[:, 0] for f in (np.floor, np.ceil))
        return below + (above - below) * (place - np.floor(place))

    return at(low), at(high)
