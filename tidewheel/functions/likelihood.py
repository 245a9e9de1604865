"""Likelihood terms as columns; times in days, counts as numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_EXPOSURE = 1e-12


def nlogn(n: Column, e: Column) -> Column:
    """n ln(n / e) - n, and 0 for n = 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(F.greatest(n, F.lit(1)) / F.greatest(e, F.lit(LEAST_EXPOSURE))) - n)


def two_bin(n_in: Column, e_in: Column, n: Column, live: Column) -> Column:
    """Profile log-likelihood of two rates, one inside the visits; pooled if the rate inside is the smaller or nothing is exposed there."""
    n_out, e_out = n - n_in, live - e_in
    inside, outside = F.greatest(e_in, F.lit(LEAST_EXPOSURE)), F.greatest(e_out, F.lit(LEAST_EXPOSURE))
    pooled = (n_in / inside < n_out / outside) | (e_in <= 0)
    return F.when(pooled, nlogn(n, live)).otherwise(nlogn(n_in, inside) + nlogn(n_out, outside))


def explicit_two_bin(n_in: Column, e_in: Column, rate_in: Column, n_out: Column, e_out: Column, rate_out: Column) -> Column:
    """Log-likelihood of given rates: n ln(rate) - rate * exposure in both bins."""

    def term(n: Column, e: Column, rate: Column) -> Column:
        return F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(F.greatest(rate, F.lit(1e-300)))) - rate * e

    return term(n_in, e_in, rate_in) + term(n_out, e_out, rate_out)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight units up, then the recurrence down."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    high = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series
    for i in range(8):
        high = high - F.log(x + i)
    return high


def weibull_log_survival(gap: Column, shape: Column, pace: Column) -> Column:
    """-(gap * pace) ** shape, pace = rate * Gamma(1 + 1 / shape)."""
    return -F.pow(gap * pace, shape)


def weibull_log_density(gap: Column, shape: Column, pace: Column) -> Column:
    return F.log(shape / gap) + shape * F.log(gap * pace) + weibull_log_survival(gap, shape, pace)


def negative_binomial(n: Column, width: Column, alpha: Column, beta: Column) -> Column:
    """Log-likelihood of n events in a session of `width` under a gamma-mixed rate; the n! of count and arrangement cancel."""
    p = beta * width / (1 + beta * width)
    return lgamma(n + alpha) - lgamma(alpha) + alpha * F.log(1 - p) + F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p) - n * F.log(width))


TERMS = 120  # of the series and the continued fraction


def gamma_upper(s: float, x: Column) -> Column:
    """The regularised upper incomplete gamma function of a fixed s: a series below s + 1, a continued fraction above, both from the last term up."""
    steps = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))
    front = F.exp(s * F.log(F.greatest(x, F.lit(1e-300))) - x)
    series = F.aggregate(steps, F.lit(1.0), lambda acc, n: 1 + x / (n + s) * acc)
    fraction = F.aggregate(steps, x + (2 * TERMS + 1 - s), lambda acc, n: x + (2 * n - 1 - s) - n * (n - s) / acc)
    below = 1 - front * series / math.gamma(s + 1)
    return F.when(x <= 0, 1.0).when(x < s + 1, below).otherwise(front / fraction / math.gamma(s))
