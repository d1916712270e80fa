"""Inverse distribution functions of counts: how many of a kind a random draw holds.

All work over a window around the most likely count, twelve deviations to each side, by ratios of
neighbouring terms. Time and memory grow with the square root of the population at most.
"""

from __future__ import annotations

from math import exp, lgamma, log, sqrt

import numpy as np

#: Deviations of a window to each side, and counts at least; what lies outside is under 1e-30.
DEVIATIONS, LEAST = 12, 60


def _window(low: int, high: int, mode: int, spread: float, log_ratio) -> tuple[int, np.ndarray]:
    """First count of the window and the chance of each in it; ``log_ratio(k)`` is log P(k + 1) - log P(k)."""
    wide = int(DEVIATIONS * spread) + LEAST
    first, last = max(low, mode - wide), min(high, mode + wide)
    logs = np.concatenate(([0.0], np.cumsum(log_ratio(np.arange(first, last, dtype=float)))))
    p = np.exp(logs - logs.max())
    return first, p / p.sum()


def binomial(n: int, p: float) -> tuple[int, np.ndarray]:
    """Window of the successes in n trials, 0 < p < 1."""
    odds = log(p) - log(1 - p)
    return _window(0, n, min(n, int((n + 1) * p)), sqrt(n * p * (1 - p)), lambda k: np.log((n - k) / (k + 1)) + odds)


def hypergeometric(population: int, marked: int, drawn: int) -> tuple[int, np.ndarray]:
    """Window of the marked among those drawn without replacement."""
    low, high = max(0, drawn - (population - marked)), min(marked, drawn)
    share = marked / population if population else 0.0
    spread = sqrt(drawn * share * (1 - share) * (population - drawn) / max(population - 1, 1))
    mode = min(high, max(low, (drawn + 1) * (marked + 1) // (population + 2)))
    rest = population - marked - drawn
    return _window(low, high, mode, spread, lambda k: np.log((marked - k) * (drawn - k) / ((k + 1) * (rest + k + 1))))


def inverse(window: tuple[int, np.ndarray], u: np.ndarray) -> np.ndarray:
    """Least counts whose chance of not being exceeded reaches each u."""
    first, p = window
    return first + np.minimum(np.searchsorted(np.cumsum(p), u, side="left"), len(p) - 1)


def hypergeometric_tail(population: int, marked: int, drawn: int, at_least: int) -> float:
    """Chance of ``at_least`` marked among those drawn without replacement: the permutation null in closed form."""
    low, high = max(0, drawn - (population - marked)), min(marked, drawn)
    if at_least <= low or at_least > high:
        return float(at_least <= low)
    first, p = hypergeometric(population, marked, drawn)
    last, rest = first + len(p) - 1, population - marked - drawn

    def beyond(k: int) -> float:
        """Chance of more than k, in units of that of k."""
        steps = np.arange(k, min(high, k + len(p)), dtype=float)
        return float(np.exp(np.cumsum(np.log((marked - steps) * (drawn - steps) / ((steps + 1) * (rest + steps + 1))))).sum())

    if at_least <= last:
        return min(1.0, float(p[max(0, at_least - first) :].sum() + p[-1] * beyond(last)))
    # further out than any p that is told apart from 0 in a table; logarithms of large tables are less exact here
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    return exp(choose(marked, at_least) + choose(population - marked, drawn - at_least) - choose(population, drawn)) * (1 + beyond(at_least))


def hypergeometric_bounds(population: int, marked: int, drawn: int, levels=(0.025, 0.975)) -> list[int]:
    """Least counts whose chance of not being exceeded reaches each level: the random-selection null in closed form."""
    return inverse(hypergeometric(population, marked, drawn), np.array(levels)).tolist()
