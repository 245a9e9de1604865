"""Kernels and fits against recorded values, direct formulas and simple cases."""

import csv
import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.functions.special import gammaincc, nelder_mead
from tidewheel.operators import kernel, renewal

FIXTURES = Path(__file__).parent / "fixtures"


@pytest.fixture(scope="module")
def observed():
    """A campaign of 69 events in 46 sessions: times in days."""
    with (FIXTURES / "observed_events.csv").open() as f:
        t = np.sort([float(r["toa_mjd_bary"]) for r in csv.DictReader(f)])
    with (FIXTURES / "observed_windows.csv").open() as f:
        w = sorted((float(r["mjd_start_bary"]), float(r["mjd_end_bary"])) for r in csv.DictReader(f))
    return t, np.asarray([a for a, _ in w]), np.asarray([b for _, b in w])


def test_recorded_likelihoods(observed):
    t, a, b = observed
    live = float(np.sum(b - a))
    assert len(t) * math.log(len(t) / live) - len(t) == pytest.approx(104.668340, abs=1e-6)
    shape, rate, ll = renewal.fit_weibull(t, a, b)
    assert ll >= 316.4652 and shape == pytest.approx(0.266, abs=1e-3) and rate == pytest.approx(15.4146, abs=1e-2)
    alpha, beta, ll = renewal.fit_gamma_mixed(t, a, b)
    assert ll >= 283.9639 and alpha == pytest.approx(0.06703, abs=1e-4) and beta == pytest.approx(257.05, abs=0.1)


def test_recorded_statistic(observed):
    """The restricted scan's winner, and twice its gain over the best natural model (329.788473)."""
    t, a, b = observed
    span = b[-1] - a[0]
    step = 60 / 86400 / (2 * (2**7 / 24) * span)
    f0 = 1 / (2**7 / 24)
    i = np.arange(math.ceil((1 / 2.9612 - f0) / step), math.ceil((1 / 2.9610 - f0) / step))
    cell = kernel.scan(t, a, b, 1 / (f0 + i * step), True, sigmas=[32 / 1440], taus=kernel.TAUS[6:])
    assert 2 * (cell.ll - 329.788473) == pytest.approx(86.78456251617922, abs=1e-4)
    assert (cell.period, cell.tau, cell.t0) == pytest.approx((2.9611210730, 0.026696777, 0.8), abs=1e-7)


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=25, deadline=None)
def test_exposure_is_additive_and_matches_overlap(seed):
    rng = np.random.default_rng(seed)
    a = np.sort(rng.uniform(0, 60, 12))
    b = a + rng.uniform(0.01, 0.35, 12)
    period = rng.uniform(0.2, 20)
    x, e = kernel.fold_exposure(a, b, period)
    assert e[-1] == pytest.approx(np.sum(b - a)) and np.all(np.diff(e) >= -1e-9)

    def before(y, w):
        return np.floor(y / period) * w + np.minimum(np.mod(y, period), w)

    w = rng.uniform(0, period)
    assert np.interp(w, x, e) == pytest.approx(np.sum(before(b, w) - before(a, w)), abs=1e-9)


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=15, deadline=None)
def test_scan_matches_brute_force_and_chunks(seed):
    rng = np.random.default_rng(seed)
    a = np.cumsum(rng.uniform(0.5, 3, 8))
    b = a + rng.uniform(0.05, 0.3, 8)
    t = np.sort(np.concatenate([rng.uniform(lo, hi, rng.integers(0, 6)) for lo, hi in zip(a, b, strict=True)]))
    periods = rng.uniform(0.5, 3, 6)
    whole = kernel.scan(t, a, b, periods, True, sigmas=[0.1, 0.2], taus=np.asarray([0.05, 0.2]))
    parts = [kernel.scan(t, a, b, periods[i : i + 2], True, sigmas=[0.1, 0.2], taus=np.asarray([0.05, 0.2])) for i in (0, 2, 4)]
    assert whole.ll == pytest.approx(max(p.ll for p in parts))
    if math.isfinite(whole.period) and len(t):
        phi = np.mod(t - a[0] - whole.t0, whole.period)
        u = [(0, whole.tau + whole.sigma)] if whole.tau < whole.sigma else [(0, whole.sigma), (whole.tau, whole.tau + whole.sigma)]
        n_in = np.sum(np.any([(phi >= lo) & (phi < min(hi, whole.period)) for lo, hi in u], axis=0))
        grid = np.linspace(0, 1, 20001)[:-1] + 0.5 / 20000
        live = np.concatenate([lo + grid * (hi - lo) for lo, hi in zip(a, b, strict=True)])
        inside = np.any([(np.mod(live - a[0] - whole.t0, whole.period) >= lo) & (np.mod(live - a[0] - whole.t0, whole.period) < min(hi, whole.period)) for lo, hi in u], axis=0)
        e_in = float(np.sum(inside.reshape(len(a), -1).mean(axis=1) * (b - a)))
        assert float(kernel.two_bin(np.asarray(n_in), np.asarray(e_in), len(t), float(np.sum(b - a)))) == pytest.approx(whole.ll, rel=2e-2, abs=0.3)


def test_batched_streams_equal_single_ones():
    rng = np.random.default_rng(5)
    a = np.arange(10) * 2.0
    b = a + 0.3
    streams = [np.sort(rng.uniform(0, 20, n)) for n in (0, 5, 40)]
    streams = [t[np.any((t[:, None] >= a) & (t[:, None] < b), axis=1)] for t in streams]
    periods = np.linspace(0.7, 3, 9)
    assert repr(kernel.scan_streams(streams, a, b, periods, False, sigmas=[0.1])) == repr([kernel.scan(t, a, b, periods, False, sigmas=[0.1]) for t in streams])
    assert math.isnan(kernel.scan(streams[2], a, b, [], False).period)


def test_weibull_of_shape_one_is_poisson():
    a, b = np.asarray([0.0, 2.0]), np.asarray([1.0, 3.5])
    t = np.asarray([0.1, 0.4, 2.7])
    assert renewal.weibull_ll(1.0, 2.0, t, a, b) == pytest.approx(3 * math.log(2) - 2 * 2.5, abs=1e-6)
    assert renewal.weibull_ll(1.0, 2.0, t[:0], a, b) == pytest.approx(-2 * 2.5, abs=1e-6)


def test_special_functions():
    for s, x in ((0.5, 0.2), (1.0, 3.0), (2.5, 10.0), (3.7, 0.01)):
        grid = np.linspace(0, 200, 4_000_001)[1:]
        density = np.exp((s - 1) * np.log(grid) - grid - math.lgamma(s))
        assert gammaincc(s, x) == pytest.approx(float(np.sum(density[grid > x]) * 5e-5), abs=1e-3)
    at, value = nelder_mead(lambda z: float((z[0] - 3) ** 2 + (z[1] + 1) ** 2), [1.0, 1.0])
    assert at == pytest.approx([3, -1], abs=1e-2) and value < 1e-4


def test_simulators_are_seeded_and_inside_sessions():
    a, b = np.asarray([0.0, 5.0]), np.asarray([1.0, 7.0])
    for draw in (
        lambda r: renewal.simulate_homogeneous(r, 30, a, b),
        lambda r: renewal.simulate_two_rate(r, 50, 5, 0.7, 0.2, 0.0, a, b),
        lambda r: renewal.simulate_weibull(r, 0.7, 30, a, b),
        lambda r: renewal.simulate_gamma_mixed(r, 1.5, 20, a, b),
    ):
        one, two = draw(np.random.default_rng([1, 2])), draw(np.random.default_rng([1, 2]))
        assert np.array_equal(one, two) and np.all(np.diff(one) >= 0)
        assert np.all(np.any((one[:, None] >= a) & (one[:, None] < b), axis=1))
