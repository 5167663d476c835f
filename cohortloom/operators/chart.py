"""Robust exponentially weighted control chart of one series (plain Python and NumPy, no Spark)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Width of a bin of steps in the natural logarithm, and the bin of no step.
BIN, NO_STEP = 0.01, -100_000


@dataclass(frozen=True)
class ChartParams:
    """Parameters of the chart; the same for every source and every size of data.

    weight_level and weight_scale are the weights of a new reading in the level and in the scale.
    A reading further than ``limit`` scales from the level is suspected and enters the level only as
    if it stood ``clip`` scales away. After ``rebase`` suspected readings in a row on one side the level
    is taken to have changed. A spike is at most ``longest`` readings long; see spike_flags for ``lower`` and
    ``beside``. ``frozen`` readings at
    different times with one value are a stuck sensor.
    """

    weight_level: float = 0.3
    weight_scale: float = 0.1
    limit: float = 6.5
    lower: float = 4.0
    clip: float = 2.0
    rebase: int = 4
    longest: int = 3
    beside: int = 3
    frozen: int = 8
    warm_up: int = 7


def step_bins(steps: np.ndarray) -> np.ndarray:
    """Bin of each step by its logarithm, one percent wide; a step of 0 has the lowest bin of all."""
    with np.errstate(divide="ignore"):
        return np.maximum(np.floor(np.log(steps) / BIN), NO_STEP).astype(np.int64)


def scale_of(bins: np.ndarray, counts: np.ndarray) -> float:
    """Normal movement of a series, from its steps by bin in order: their median as a standard deviation."""
    total = np.cumsum(counts)
    if not len(total) or total[-1] < 2:
        return 0.0
    middle = bins[np.searchsorted(total, (total[-1] + 1) // 2)]
    return 0.0 if middle == NO_STEP else 1.4826 * float(np.exp((middle + 0.5) * BIN)) / 2**0.5


def series_scale(x: np.ndarray) -> float:
    """scale_of the steps between neighbours."""
    return scale_of(*np.unique(step_bins(np.abs(np.diff(x))), return_counts=True))


def deviations(x: np.ndarray, scale: float, least: float, p: ChartParams) -> np.ndarray:
    """Distance of each reading from the level before it, in scales, in one direction of time."""
    out = np.zeros(len(x))
    if not len(x):
        return out
    head = sorted(x[: p.warm_up].tolist())
    level, s = head[len(head) // 2], scale
    run: list[float] = []
    for i, v in enumerate(x.tolist()):
        r = v - level
        d = r / s
        out[i] = d
        if d > p.limit or d < -p.limit:
            run = [*run, v] if run and (run[-1] > level) == (r > 0) else [v]
            if len(run) >= p.rebase:
                level, run = sorted(run)[len(run) // 2], []
                continue
            level += p.weight_level * (p.clip * s if r > 0 else -p.clip * s)
        else:
            run = []
            level += p.weight_level * r
            a = min(abs(r), p.clip * s) * 1.2533
            s = max(least, (1 - p.weight_scale) * s + p.weight_scale * max(a, 0.5 * scale))
    return out


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and one-past-last position of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def spike_flags(x: np.ndarray, least: float, p: ChartParams, scale: float | None = None) -> np.ndarray:
    """True for readings that stand far from the level before and the level after, at most ``longest`` in a row.

    The chart runs in both directions of time: a lasting change of level is far from one side only. A run
    begins with a reading beyond ``limit`` and takes in neighbours on the same side beyond ``lower``; if it
    grows too long by that, only the readings beyond ``limit`` count. At least ``beside`` readings must stand
    before and after it, else there is no level to compare with. ``scale`` is the normal movement of the series
    if ``x`` is only a piece of it.
    """
    if len(x) <= 2 * p.beside:
        return np.zeros(len(x), bool)
    scale = max(least, series_scale(x) if scale is None else scale)
    ahead = deviations(x, scale, least, p)
    back = deviations(x[::-1], scale, least, p)[::-1]
    far = np.where(np.sign(ahead) == np.sign(back), np.minimum(np.abs(ahead), np.abs(back)), 0.0)
    flags = np.zeros(len(x), bool)
    high = far > p.limit
    if not high.any():
        return flags
    side = np.sign(ahead)
    for a, b in runs_of(far > p.lower):
        cuts = [a, *(i for i in range(a + 1, b) if side[i] != side[i - 1]), b]
        for lo, hi in zip(cuts, cuts[1:]):
            spans = [(lo, hi)] if hi - lo <= p.longest else [(lo + s, lo + e) for s, e in runs_of(high[lo:hi])]
            for s, e in spans:
                if high[s:e].any() and e - s <= p.longest and s >= p.beside and len(x) - e >= p.beside:
                    flags[s:e] = True
    return flags


def frozen_flags(t: np.ndarray, x: np.ndarray, p: ChartParams) -> np.ndarray:
    """True for readings in a run of one exact value over at least ``frozen`` different times (run-length counter)."""
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    ends = np.append(starts[1:], n)
    later = np.concatenate(([0], np.cumsum(t[1:] != t[:-1])))
    times = later[ends - 1] - later[starts] + 1
    return np.repeat(times >= p.frozen, ends - starts)
