"""Sweeps over end points, nearest sessions, noise, exact percentiles, the alias set and batched streams, against brute force."""

import csv
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewheel.functions import arrival, astronomy, noise
from tidewheel.operators import alias, events, quantiles
from tidewheel.operators import lattice as lat
from tidewheel.plans import frames, phases, study

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
HOUR = 3_600_000_000
INTERVALS = "campaign string, id int, a bigint, b bigint"


def some_intervals(dice, n, longest):
    return [("cd"[dice.randrange(2)], i, a := dice.randrange(-40, 200) * HOUR, a + dice.randrange(1, longest) * HOUR // 2) for i in range(n)]


def test_overlaps_and_precedence_equal_all_pairs(spark):
    dice = random.Random(5)
    layers = [some_intervals(dice, n, longest) for n, longest in ((12, 9), (40, 12), (60, 400))]
    frames_ = [spark.createDataFrame(x, INTERVALS) for x in layers]
    cross = lambda x, y: x[0] == y[0] and x[2] < y[3] and y[2] < x[3]
    got = {tuple(r) for r in events.overlaps(frames_[1], frames_[2]).collect()}
    assert got == {(*x, any(cross(x, y) for y in layers[2])) for x in layers[1]} and {g[-1] for g in got} == {True, False}
    kept = list(layers[0])
    for layer in layers[1:]:
        kept += [x for x in layer if not any(cross(x, y) for y in kept)]
    assert {tuple(r) for r in events.precedence_merge(frames_).collect()} == set(kept)
    nothing = frames_[0].limit(0)
    assert [r["hit"] for r in events.overlaps(frames_[0], nothing).collect()] == [False] * 12
    assert events.overlaps(nothing, frames_[0]).collect() == []


def test_pinned_merge_by_hand(spark):
    first = [("c", "P", 1, 0, 100)]
    second = [("c", "K", 1, 90, 120), ("c", "K", 2, 200, 300), ("c", "K", 3, 400, 500), ("c", "K", 4, 600, 700), ("d", "K", 5, 0, 10)]
    third = [("c", "N", 1, 50, 60), ("c", "N", 2, 290, 310), ("c", "N", 3, 504, 550), ("c", "N", 4, 705, 750), ("c", "N", 5, 100, 110), ("d", "N", 6, 100, 110)]
    make = lambda rows: spark.createDataFrame(rows, "campaign string, layer string, id int, a bigint, b bigint")
    merged = events.pinned_merge(make(first), make(second), make(third), 5)
    got = {(r["layer"], r["id"]): r["verdict"] for r in merged.collect()}
    want = {("P", 1): "kept", ("K", 1): "consumed", ("K", 2): "kept", ("K", 3): "kept", ("K", 4): "dropped", ("K", 5): "dropped"}
    assert got == want | {("N", 1): "consumed", ("N", 2): "consumed", ("N", 3): "consumed", ("N", 4): "kept", ("N", 5): "kept", ("N", 6): "kept"}
    expected = spark.createDataFrame([("c", 4), ("d", 5)], "campaign string, id int")
    assert events.require_dropped(merged, expected).count() == 6
    with pytest.raises(ValueError, match="dropped"):
        events.require_dropped(merged, expected.limit(1))


def test_events_settle_in_the_nearest_session(spark):
    dice = random.Random(8)
    windows = [("c", a := (10 * i + dice.randrange(4)) * HOUR, a + dice.randrange(1, 5) * HOUR) for i in range(20)] + [("d", 5 * HOUR, 6 * HOUR)]
    times = [(c, i, dice.randrange(-30 * HOUR, 230 * HOUR)) for i, c in enumerate("cccd" * 60)] + [("nowhere", -1, 3)]
    times += [("d", 900, 5 * HOUR), ("d", 901, 6 * HOUR), ("c", 902, (windows[0][2] + windows[1][1]) // 2)]
    got = {r["id"]: r["t"] for r in events.settled(spark.createDataFrame(times, "campaign string, id int, t bigint"), spark.createDataFrame(windows, "campaign string, a bigint, b bigint")).collect()}
    want = {i: min((min(max(t, a), b) for k, a, b in windows if k == c), key=lambda x: (abs(x - t), x)) for c, i, t in times if c != "nowhere"}
    assert got == want


def test_noise_depends_on_keys_only(spark):
    rows = spark.range(20_000)
    made = rows.select("id", noise.uniform(3, F.col("id")).alias("u"), noise.normal(1, F.col("id")).alias("z"))
    table = made.toPandas()
    again = rows.repartition(7).orderBy(F.desc("id")).select("id", noise.uniform(3, F.col("id")).alias("u"), noise.normal(1, F.col("id")).alias("z")).toPandas().sort_values("id")
    assert np.array_equal(table["u"], again["u"]) and np.array_equal(table["z"], again["z"])
    assert 0 < table["u"].min() < 0.001 and 0.999 < table["u"].max() < 1
    assert abs(table["u"].mean() - 0.5) < 0.01 and abs(table["z"].mean()) < 0.03 and abs(table["z"].std() - 1) < 0.02


@pytest.mark.parametrize(("steps", "leaf"), [(4096, 4096), (5, 3)])
def test_percentiles_equal_those_of_sorted_values(spark, monkeypatch, steps, leaf):
    monkeypatch.setattr(quantiles, "STEPS", steps)
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    dice = random.Random(2)
    groups = {"even": [dice.random() for _ in range(301)], "tied": [1.0] * 100 + [dice.gauss(0, 1) for _ in range(200)], "wide": [1e300, -1e300, 5e-324, 0.0, -0.5, 1e-300, 3.0], "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 50, None: [3.0, 1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    shares = {"least": 0.0, "p10": 0.1, "half": 0.5, "p99": 0.99, "p99.9": 0.999, "most": 1.0}
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in quantiles.exact_percentiles(table, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        ordered = sorted(vs)
        for name, q in shares.items():
            at = q * (len(vs) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12, abs=1e-300)
    assert quantiles.exact_percentiles(table.limit(0), ["g"], "v", shares).collect() == []
    with pytest.raises(PySparkException, match="not finite"):
        quantiles.exact_percentiles(spark.createDataFrame([("g", float("nan"))], "g string, v double"), ["g"], "v", shares).collect()


def test_islands_equal_a_walk(spark):
    dice = random.Random(11)
    rows = [("ab"[dice.randrange(2)], lo := dice.randrange(3000), lo + dice.choice([0, 0, 1, 5, 200])) for _ in range(250)]
    frame = spark.createDataFrame(rows, "k string, lo bigint, hi bigint").withColumn(events.BUCKET, F.floor(F.col("lo") / 64))
    got = {(r["k"], r["lo"], r["hi"]): r["island"] for r in events.islands(frame, ["k"]).collect()}
    for k in "ab":
        number, reach = 0, -10
        for _, lo, hi in sorted(r for r in rows if r[0] == k):
            number += lo > reach + 1
            reach = max(reach, hi)
            assert got[k, lo, hi] == number


def observed_sessions(spark):
    with open(Path(__file__).parent / "fixtures" / "eighteen_windows.csv") as f:
        rows = [(float(r["mjd_start"]), float(r["duration_s"]) / 86400) for r in csv.DictReader(f)]
    return spark.createDataFrame([("c", a, a + d) for a, d in rows], "campaign string, a double, b double")


def test_alias_set_of_a_recorded_campaign(spark, tmp_path):
    """Published: 466,756 grid points in 8 octaves, 11 peak intervals, a share of 0.4278 flagged."""
    windows = observed_sessions(spark)
    first = [r.asDict() for r in alias.write_alias_set(windows, str(tmp_path / "set")).collect()]
    assert len(first) == 1
    row = first[0]
    assert (row["n_sessions"], row["n_f_total"], row["n_peak_intervals"], round(row["flagged_frac"], 4)) == (18, 466_756, 11, 0.4278)
    octaves = spark.read.json(str(tmp_path / "set" / "octaves"))
    assert octaves.count() == 8 and octaves.agg(F.sum("n_f")).first()[0] == 466_756
    other = windows.withColumn("campaign", F.lit("other")).limit(5)
    alias.write_alias_set(other, str(tmp_path / "set"), 0.5, 0.05)
    again = alias.write_alias_set(windows, str(tmp_path / "set")).collect()
    assert [r.asDict() for r in again if r["campaign"] == "c"] == first and {r["campaign"] for r in again} == {"c", "other"}


def test_runs_are_whole_across_chunks(spark, monkeypatch):
    windows = observed_sessions(spark)
    spans = windows.groupBy("campaign").agg((F.max_by("b", "a") - F.min("a")).alias("span"))
    octaves = lat.octave_grid(spans, 1 / 24, 1200 / 86400)
    found = []
    for chunk in (4096, 7):
        monkeypatch.setattr(alias, "CHUNK", chunk)
        runs = alias.window_runs(octaves, windows)
        found.append((sorted(map(repr, runs.collect())), sorted(map(repr, alias.alias_octaves(octaves, runs).collect()))))
    assert found[0] == found[1] and max(r["n_points"] for r in runs.collect()) > 7


@needs_data
def test_batched_streams_equal_one_scan_each(spark):
    together = {(r["campaign"], r["stream"]): r.asDict() for r in phases.stream_scan(spark, DATA).collect()}
    observed = frames.observed(spark, DATA)
    order = ["e_us", "period_id", "sigma_id", "i"]
    for s in (0, 5):
        own = observed.filter(F.col("user_id") % 8 == s).select("campaign", "t")
        cells = lat.scan(own, frames.windows(spark, DATA).select("campaign", "a", "b"), phases._single(spark, DATA)).filter("n_in > 0")
        best = lat.first_best(cells.select("campaign", *order, "ll", "n_in"), ["campaign"], order).collect()
        assert best
        for r in best:
            assert {k: together[r["campaign"], s][k] for k in (*order, "ll", "n_in")} == {k: r[k] for k in (*order, "ll", "n_in")}


def test_arrival_columns_equal_the_direct_computation(spark):
    times = np.linspace(57760.0, 60900.0, 41)
    rows = [(float(t), site, float(ra), float(dec)) for t, site, ra, dec in zip(times, ["torun", "effelsberg", "Onsala85"] * 14, np.linspace(0, 350, 41), np.linspace(-80, 80, 41), strict=False)]
    known = {r["site"]: (r["x"], r["y"], r["z"]) for r in arrival.sites(spark).collect()}
    table = spark.createDataFrame([(*r, *known[r[1].lower()]) for r in rows], "utc double, site string, ra double, dec double, x double, y double, z double")
    got = arrival.with_arrival(table).collect()
    for r in got:
        assert abs(r["bjd"] - astronomy.barycentric(np.asarray([r["utc"]]), r["site"], r["ra"], r["dec"])[0]) < 1e-9


def test_leap_seconds_are_looked_up_as_of_the_day(spark):
    """Announced steps: 10 s from 1972, 32 from 1999, 33 from 2006, 37 from 2017; an hour before each it is one less."""
    want = {41316.9: None, 41317.0: 10, 41498.9: 10, 41499.0: 11, 51178.9: 31, 51179.0: 32, 53735.9: 32, 53736.0: 33, 57753.99: 36, 57754.0: 37, 60900.0: 37}
    got = spark.createDataFrame([(x,) for x in want], "m double").select("m", arrival.leap_seconds(F.col("m")).alias("s")).collect()
    assert {r["m"]: r["s"] for r in got} == want
    eccentric = spark.createDataFrame([(m / 10, e / 10) for m in range(-30, 31) for e in range(4)], "m double, e double").select("m", "e", arrival.eccentric_anomaly(F.col("m"), F.col("e")).alias("x")).collect()
    assert all(abs(r["x"] - r["e"] * math.sin(r["x"]) - r["m"]) < 1e-12 for r in eccentric)


def test_gates_come_before_a_study(spark, tmp_path):
    (tmp_path / "report.txt").write_text("one failed\n")
    nothing = ({}, str(tmp_path / "units"))
    with pytest.raises(ValueError, match="ALL PASS"):
        study.confirm(spark, *nothing, validated=str(tmp_path / "report.txt"))
    with pytest.raises(ValueError, match="recorded"):
        study.confirm(spark, *nothing, conversion=(np.asarray([1.0]), np.asarray([1.1])))


def test_the_live_rule_by_its_whole_grid(spark):
    windows = spark.createDataFrame([("c", i * 86_400_000_000, (24 * i + 5) * HOUR) for i in range(20)], "campaign string, a bigint, b bigint")
    tol = 2 / (19 + 5 / 24)
    peaks = spark.createDataFrame([("c", k, 0.05 + 0.083 * k, tol) for k in range(60)], "campaign string, peak_id int, f double, tol double")
    a = np.arange(20.0)
    b = a + 5 / 24
    for r in alias.flag_live(peaks, windows).collect():
        g = np.arange(tol, max(3.0, 1.5 * r["f"]), tol / 4)
        power = np.abs(np.sum(np.exp(2j * np.pi * np.outer(g, b)) - np.exp(2j * np.pi * np.outer(g, a)), axis=1) / (2 * np.pi * g)) ** 2 / np.sum(b - a) ** 2
        assert r["near_peak"] == bool(np.any(np.abs(g[power > 0.2] - r["f"]) < tol)), r
        assert r["rational"] == any(abs(r["f"] - x) < tol for x in alias.day_rational_values())
