"""Resampling: seeded numpy work on bounded groups."""

from __future__ import annotations

from math import comb

import numpy as np


def bootstrap_interval(values: np.ndarray, groups: np.ndarray, draws: int = 500, seed: int = 7, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean, and the percentile interval of means over resampled groups."""
    names, at = np.unique(groups, return_inverse=True)
    total, n = np.bincount(at, values), np.bincount(at)
    pick = np.random.default_rng(seed).integers(0, len(names), (draws, len(names)))
    means = total[pick].sum(1) / n[pick].sum(1)
    low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
    return float(values.mean()), float(low), float(high)


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided p of a fair coin on the discordant pairs."""
    n, k = only_a + only_b, min(only_a, only_b)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


#: Cumulative shares of a Poisson distribution of mean 1.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16.0)])))


def resample_counts(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each key is in each of the resamples: Poisson counts of mean 1 that depend on key, resample and seed alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] ^ (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right")
