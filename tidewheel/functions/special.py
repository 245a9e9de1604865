"""Special functions and optimisers on numpy, for the kernels that run in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np


def gammaincc(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below s + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], iterations: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Least value of f found by the downhill simplex from `start`."""
    start = np.asarray(start, dtype=float)
    n = len(start)
    simplex = [start] + [start + np.eye(n)[i] * (0.05 * start[i] if start[i] else 0.00025) for i in range(n)]
    values = [f(p) for p in simplex]
    for _ in range(iterations):
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance and max(np.abs(p - simplex[0]).max() for p in simplex) <= 1e-4:
            break
        centre = np.mean(simplex[:-1], axis=0)
        reflected = 2 * centre - simplex[-1]
        value = f(reflected)
        if value < values[0]:
            further = 3 * centre - 2 * simplex[-1]
            beyond = f(further)
            simplex[-1], values[-1] = (further, beyond) if beyond < value else (reflected, value)
        elif value < values[-2]:
            simplex[-1], values[-1] = reflected, value
        else:
            target = reflected if value < values[-1] else simplex[-1]
            inner = 0.5 * (centre + target)
            within = f(inner)
            if within < min(value, values[-1]):
                simplex[-1], values[-1] = inner, within
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    best = int(np.argmin(values))
    return simplex[best], float(values[best])


def hessian(f: Callable[[np.ndarray], float], at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Second derivatives by central differences; four points for each mixed one."""
    n = len(at)
    out = np.zeros((n, n))
    e = np.diag(steps)
    middle = f(at)
    for i in range(n):
        out[i, i] = (f(at + e[i]) - 2 * middle + f(at - e[i])) / steps[i] ** 2
        for j in range(i):
            out[i, j] = out[j, i] = (f(at + e[i] + e[j]) - f(at + e[i] - e[j]) - f(at - e[i] + e[j]) + f(at - e[i] - e[j])) / (4 * steps[i] * steps[j])
    return out


def laplace_covariance(curvature: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Inverse of a log-likelihood's negative curvature, its eigenvalues kept above the inverse square of five steps."""
    values, vectors = np.linalg.eigh(0.5 * (curvature + curvature.T))
    return vectors @ np.diag(1 / np.maximum(values, 1 / (5 * steps.max()) ** 2)) @ vectors.T
