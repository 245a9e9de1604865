"""Distributed fits and scans against the same on one campaign's arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import calibration, kernel, renewal
from tidewheel.plans import frames, models

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arrays(spark):
    t = {}
    for r in frames.observed(spark, DATA).select("campaign", (F.col("t") / 8.64e10).alias("t")).collect():
        t.setdefault(r["campaign"], []).append(r["t"])
    return {r["campaign"]: (np.sort(t.get(r["campaign"], [])), np.asarray(r["a"]), np.asarray(r["b"])) for r in models._sessions(spark, DATA).collect()}


def test_fits_from_sums_are_as_good_as_from_arrays(spark, arrays):
    for r in models.fit_m4(spark, DATA).collect():
        shape, rate, ll = renewal.fit_weibull(*arrays[r["campaign"]])
        assert r["ll"] >= ll - 1e-3 and r["ll"] == pytest.approx(renewal.weibull_ll(r["p"], r["q"], *arrays[r["campaign"]]), abs=1e-6)
    for r in models.fit_m5(spark, DATA).collect():
        assert r["ll"] == pytest.approx(renewal.fit_gamma_mixed(*arrays[r["campaign"]])[2], abs=1e-6)


def test_covariances_from_sums_match_those_from_arrays(spark, arrays):
    fits = {("M4", r["campaign"]): r for r in models.fit_m4(spark, DATA).collect()} | {("M5", r["campaign"]): r for r in models.fit_m5(spark, DATA).collect()}
    for r in models.laplace_covariance(spark, DATA).collect():
        f = fits[r["family"], r["campaign"]]
        want = renewal.laplace(r["family"], [math.log(f["p"]), math.log(f["q"])], *arrays[r["campaign"]])
        assert np.allclose(np.asarray(r["cov"]), want.ravel(), rtol=1e-3, atol=1e-6)


def test_counts_by_task_give_the_scan_of_all_events(spark, arrays):
    for r in models.kernel_scan(spark, DATA).collect():
        cell = kernel.scan(*arrays[r["campaign"]], models._KERNEL_PERIODS, r["model"] == "M3", **models._KERNEL_SCAN)
        assert r["ll"] == pytest.approx(cell.ll, abs=1e-6) and r["period"] == pytest.approx(cell.period)


def test_simulations_use_the_recorded_family_numbers(spark, arrays):
    """A stream of a family has the same seed wherever it is drawn."""
    order = sorted(arrays)
    for r in models.simulate_m5(spark, DATA).filter("sim < 2").collect():
        t, a, b = arrays[r["campaign"]]
        rng = np.random.default_rng([calibration.SEED, calibration.FAMILY_IDS["M5"], order.index(r["campaign"]), r["sim"]])
        s = renewal.simulate_gamma_mixed(rng, models.ALPHA, max(len(t), 1) / float(np.sum(b - a)) / models.ALPHA, a, b)
        assert r["n_events"] == len(s)
