"""Session models on one campaign's arrays: Weibull renewal, gamma-mixed Poisson, their fits and simulators.

A campaign's or simulation's events and sessions are one group (thousands of rows at
most, by the nature of the data); groups are spread over the cluster by their keys.
Simulators are seeded by key, so that draws do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tidewheel.functions.special import gammaincc, hessian, laplace_covariance, nelder_mead

SHORTEST_GAP = 1e-9
FLOOR = 1e-300


def by_session(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The sorted events of each half-open session; overlapping sessions each have theirs."""
    return [t[np.searchsorted(t, lo, "left") : np.searchsorted(t, hi, "left")] for lo, hi in zip(a, b, strict=True)]


def weibull_ll(shape: float, rate: float, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Sessions start anew: the wait for the first event is the forward recurrence time, the last wait is cut off."""
    pace = rate * math.gamma(1 + 1 / shape)
    total = 0.0
    for own, lo, hi in zip(by_session(t, a, b), a, b, strict=True):
        if not len(own):
            left = rate / (shape * pace) * math.gamma(1 / shape) * gammaincc(1 / shape, ((hi - lo) * pace) ** shape)
            total += math.log(max(left, FLOOR))
            continue
        gaps = np.maximum(np.diff(own), SHORTEST_GAP)
        first, tail = max(own[0] - lo, SHORTEST_GAP), max(hi - own[-1], SHORTEST_GAP)
        total += math.log(rate) - (first * pace) ** shape - (tail * pace) ** shape
        total += float(np.sum(np.log(shape / gaps) + shape * np.log(gaps * pace) - (gaps * pace) ** shape))
    return total


def gamma_counts_ll(alpha: float, beta: float, n: np.ndarray, w: np.ndarray) -> float:
    """The gamma-mixed likelihood needs no more of a session than its number of events and its width."""
    p = beta * w / (1 + beta * w)
    ways = sum(map(math.lgamma, n + alpha)) - len(n) * math.lgamma(alpha)
    some = n > 0
    return float(ways + alpha * np.log1p(-p).sum() + (n[some] * np.log(p[some] / w[some])).sum())


def gamma_mixed_ll(alpha: float, beta: float, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return gamma_counts_ll(alpha, beta, np.asarray([len(own) for own in by_session(t, a, b)]), np.asarray(b - a, float))


@dataclass(frozen=True)
class Waits:
    """What the renewal likelihood needs of a campaign at one shape: sums over its waits, and the widths of its empty sessions.

    The sums add up over events, so they can be made anywhere; the rate enters the
    likelihood beside them.
    """

    sessions: float  # with events
    gaps: float  # waits between events
    log_gaps: float  # sum of their logarithms
    powers: float  # sum of wait ** shape over all waits, first and last ones of sessions too
    empty: np.ndarray

    def ll(self, shape: float, rate: float) -> float:
        pace = rate * math.gamma(1 + 1 / shape)
        bare = sum(math.log(max(gammaincc(1 / shape, (w * pace) ** shape), FLOOR)) for w in self.empty)
        return self.sessions * math.log(rate) + self.gaps * (math.log(shape) + shape * math.log(pace)) + (shape - 1) * self.log_gaps - pace**shape * self.powers + bare

    def best_rate(self, shape: float, guess: float) -> tuple[float, float]:
        """(rate, ll) of the greatest likelihood at the shape: the pace without empty sessions in closed form, then a golden section."""
        total = self.sessions + shape * self.gaps
        start = math.log((total / (shape * self.powers)) ** (1 / shape) / math.gamma(1 + 1 / shape)) if self.powers > 0 and total > 0 else math.log(guess)
        low, high, part = start - 6, start + 2, (math.sqrt(5) - 1) / 2
        for _ in range(60):
            left, right = high - part * (high - low), low + part * (high - low)
            if self.ll(shape, math.exp(left)) < self.ll(shape, math.exp(right)):
                low = left
            else:
                high = right
        rate = math.exp((low + high) / 2)
        return rate, self.ll(shape, rate)


def fit_weibull(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(shape, rate, ll) of the best of nine starts."""
    live = float(np.sum(b - a))
    if len(t) < 2:
        return 1.0, len(t) / live, len(t) * math.log(max(len(t), 1) / live) - len(t)

    def cost(z: np.ndarray) -> float:
        return -weibull_ll(float(np.clip(math.exp(np.clip(z[0], -20, 20)), 0.05, 5)), math.exp(float(np.clip(z[1], -50, 50))), t, a, b)

    best = min((nelder_mead(cost, [math.log(k), math.log(len(t) / live * f)]) for k in (0.3, 0.7, 1.0) for f in (0.5, 1.0, 2.0)), key=lambda r: r[1])
    shape, rate = np.exp(np.clip(best[0], -50, 50))
    return float(np.clip(shape, 0.05, 5)), float(rate), -best[1]


def fit_gamma_mixed(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(alpha, beta, ll) of the best of three starts."""
    rate = max(len(t), 1) / float(np.sum(b - a))

    n, w = np.asarray([len(own) for own in by_session(t, a, b)]), np.asarray(b - a, float)
    return fit_gamma_counts(n, w, rate)


def fit_gamma_counts(n: np.ndarray, w: np.ndarray, rate: float) -> tuple[float, float, float]:
    def cost(z: np.ndarray) -> float:
        return -gamma_counts_ll(math.exp(float(np.clip(z[0], -30, 30))), math.exp(float(np.clip(z[1], -30, 30))), n, w)

    best = min((nelder_mead(cost, [math.log(x), math.log(rate / x)], 400) for x in (0.3, 1.0, 3.0)), key=lambda r: r[1])
    alpha, beta = np.exp(np.clip(best[0], -30, 30))
    return float(alpha), float(beta), -best[1]


def laplace(family: str, z: Sequence[float], t: np.ndarray, a: np.ndarray, b: np.ndarray, step: float = 0.02) -> np.ndarray:
    """Covariance of the logarithms of a fit's two parameters."""
    model = weibull_ll if family == "M4" else gamma_mixed_ll
    steps = np.full(2, step)
    return laplace_covariance(hessian(lambda x: -model(math.exp(x[0]), math.exp(x[1]), t, a, b), np.asarray(z, float), steps), steps)


def simulate_homogeneous(rng: np.random.Generator, rate: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([rng.uniform(lo, hi, rng.poisson(rate * (hi - lo))) for lo, hi in zip(a, b, strict=True)] or [np.zeros(0)]))


def simulate_two_rate(rng: np.random.Generator, rate_in: float, rate_out: float, period: float, width: float, origin: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Candidates at the larger rate, kept in proportion to the rate at their phase."""
    top = max(rate_in, rate_out, FLOOR)
    t = simulate_homogeneous(rng, top, a, b)
    local = np.where(np.mod(t - origin, period) < width, rate_in, rate_out)
    return t[rng.random(len(t)) * top < local]


def simulate_weibull(rng: np.random.Generator, shape: float, rate: float, a: np.ndarray, b: np.ndarray, lead: float = 50.0) -> np.ndarray:
    """An ordinary renewal process begun `lead` days before the first session; an event in several sessions counts once."""
    scale = 1 / (rate * math.gamma(1 + 1 / shape))
    now, end, found = float(a.min()) - lead, float(b.max()), []
    while now < end:
        found.append(now + np.cumsum(scale * rng.weibull(shape, 1024)))
        now = float(found[-1][-1])
    t = np.concatenate(found)
    return t[np.any((t[:, None] >= a) & (t[:, None] < b), axis=1)] if len(a) else t[:0]


def simulate_gamma_mixed(rng: np.random.Generator, alpha: float, beta: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rates = rng.gamma(alpha, beta, len(a))
    return np.sort(np.concatenate([rng.uniform(lo, hi, rng.poisson(r * (hi - lo))) for r, lo, hi in zip(rates, a, b, strict=True)] or [np.zeros(0)]))
