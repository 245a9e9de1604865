"""Studies end to end on small inputs, sinks, text sources, the stream merger and arrival times."""

import csv
import itertools
import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import types as T

from tidewheel.functions import astronomy
from tidewheel.operators import calibration, kernel
from tidewheel.operators.lattice import octave_grid
from tidewheel.plans import study
from tidewheel.sources import sinks, text
from tidewheel.streaming.merger import merge_stream

FIXTURES = Path(__file__).parent / "fixtures"
SIGMAS = {"sigmas": [0.1, 0.2], "taus": np.asarray([0.05, 0.15])}


def observed():
    with (FIXTURES / "observed_events.csv").open() as f:
        t = np.sort([float(r["toa_mjd_bary"]) for r in csv.DictReader(f)])
    with (FIXTURES / "observed_windows.csv").open() as f:
        w = sorted((float(r["mjd_start_bary"]), float(r["mjd_end_bary"])) for r in csv.DictReader(f))
    return t, np.asarray([a for a, _ in w]), np.asarray([b for _, b in w])


def small(seed=0, n=12):
    rng = np.random.default_rng(seed)
    a = np.cumsum(rng.uniform(0.6, 2, n))
    b = a + 0.3
    return calibration.renewal.simulate_homogeneous(rng, 8, a, b), a, b


def test_activity_window_fit_has_the_recorded_value():
    ll, period, duty, phase = calibration.activity_scan(*observed())
    assert ll == pytest.approx(329.788473, abs=1e-6) and (duty, phase) == (0.05, pytest.approx(1 / 3)) and period == pytest.approx(27.530641, abs=1e-6)


def test_grid_sizes_are_the_recorded_ones(spark):
    """Spans that recorded studies had: numbers of periods and octaves."""
    t, a, b = observed()
    rows = octave_grid(spark.createDataFrame([("x", float(b[-1] - a[0]))], "campaign string, span double"), 1 / 24, 60 / 86400).collect()
    assert len(rows) == 12 and abs(sum(r["n_f"] for r in rows) - 16_996_628) < 200
    assert [r["t_lo"] * 24 for r in sorted(rows, key=lambda r: r["octave"])] == pytest.approx([2.0**k for k in range(12)])


def test_confirm_resumes_and_matches_a_direct_scan(spark, tmp_path):
    t, a, b = small()
    inputs = {"one": (t, a, b), "none": (t[:0], a, b)}
    kwargs = dict(least_period=0.5, sigma=0.1, chunk=40, **SIGMAS)
    rows = {r["campaign"]: r for r in study.confirm(spark, inputs, str(tmp_path / "units"), **kwargs).collect()}
    units = study.scan_units(spark, inputs, 0.5, 0.1, 40).filter("campaign = 'one' and model = 'M3'").collect()
    periods = np.concatenate([1 / (1 / u["t_hi"] + np.arange(u["first"], u["first"] + u["size"]) * u["df"]) for u in units])
    assert rows["one"]["M3"] == pytest.approx(kernel.scan(t, a, b, periods, True, **SIGMAS).ll)
    assert rows["none"]["lam"] == pytest.approx(2 * (0 - max(rows["none"][m] for m in ("M0", "M1", "M4", "M5"))))
    store = sinks.UnitStore(spark, str(tmp_path / "units"), study.UNIT_SCHEMA, ["campaign", "octave", "model", "chunk"])
    assert store.pending(study.scan_units(spark, inputs, 0.5, 0.1, 40)).isEmpty()
    assert sorted(map(repr, study.confirm(spark, inputs, str(tmp_path / "units"), **kwargs).collect())) == sorted(map(repr, rows.values()))


def test_calibration_draws_depend_on_keys_only(spark):
    inputs = {"one": small(1), "two": small(2, 8)}
    fits = study.fit_nulls(spark, inputs)
    assert set(fits) == {(c, f) for c in inputs for f in calibration.FAMILY_IDS}
    run = lambda first, last: study.simulate_study(spark, inputs, fits, ["M0", "M5"], first, last, np.linspace(0.7, 2, 6), **SIGMAS)
    whole = sorted(map(repr, run(0, 4).collect()))
    parts = sorted(map(repr, run(0, 1).union(run(1, 4)).collect()))
    assert whole == parts and len(whole) == 16
    table = study.collate(run(0, 4).filter("not (sim = 3 and campaign = 'two')"), 2, -1e9).collect()
    assert {(r["family"], r["n_sims"], r["n_ge"], r["fap"], r["complete"]) for r in table} == {("M0", 3, 3, 1.0, False), ("M5", 3, 3, 1.0, False)}


def test_acceptance_recovers_injections(spark):
    a = np.arange(30) * 0.8
    out = study.acceptance(spark, (a, a + 0.3), np.linspace(0.9, 2.1, 13), sims=8, injections=3, sigmas=[0.2], taus=np.asarray([0.15]), rate=20.0)
    assert all(v["share"] >= 0.9 for k, v in out.items() if k.startswith("recovery"))
    assert {k for k in out if k.startswith("null")} == {f"null {m}" for m in ("M0", "M1", "M4", "M5")}


def test_input_guard_refuses_to_lose_many_events(spark):
    events = spark.createDataFrame([("c", i, i * 10_000_000, 1.0) for i in range(100)], "campaign string, event_id bigint, t bigint, w double")
    windows = spark.createDataFrame([("c", 0, 1_000_000_000)], "campaign string, a bigint, b bigint")
    assert study.clean_inputs(events, windows).count() == 100
    with pytest.raises(ValueError, match="outside"):
        study.clean_inputs(events, windows.selectExpr("campaign", "a", "b div 2 as b"))


def test_jitter_stays_in_sessions_and_ks_is_sane():
    t, a, b = small(4)
    moved = calibration.jittered(np.random.default_rng(0), t, a, b, 5000)
    assert np.all(np.any((moved[:, None] >= a) & (moved[:, None] <= b), axis=1)) and len(moved) == len(t)
    rng = np.random.default_rng(3)
    assert calibration.two_sample_p(rng.random(200), rng.random(200)) > 0.01 > calibration.two_sample_p(rng.random(200), rng.random(200) + 0.5)
    with pytest.raises(ValueError):
        calibration.statistic(np.asarray([a[0] - 1]), a, b, np.asarray([1.0]))


@pytest.mark.parametrize(("m", "n"), [(1, 1), (2, 3), (4, 4), (3, 5)])
def test_two_sample_p_matches_all_orders(m, n):
    def distance(of_x):
        steps = np.zeros(m + n)
        steps[list(of_x)] = 1
        return int(np.max(np.abs(np.cumsum(steps) * n - np.cumsum(1 - steps) * m)))

    orders = list(itertools.combinations(range(m + n), m))
    for of_x in orders:
        x = np.asarray(of_x, dtype=float)
        y = np.asarray([v for v in range(m + n) if v not in of_x], dtype=float)
        want = np.mean([distance(o) >= distance(of_x) for o in orders])
        assert calibration.two_sample_p(x, y) == pytest.approx(want)
    assert calibration.two_sample_p(np.zeros(m), np.zeros(n)) == 1.0 == calibration.two_sample_p(np.zeros(0), np.zeros(n))


def test_sinks_read_back(spark, tmp_path):
    events = spark.createDataFrame([("c", "e1", 59000.123456789012), ("c", "e2", 1e-9)], "campaign string, event_id string, t double")
    windows = spark.createDataFrame([("c", 1.5, 2.5), ("d", 0.0, 1.0)], "campaign string, a double, b double")
    manifest = {r["campaign"]: r for r in sinks.export_inputs(events, windows, str(tmp_path / "x")).collect()}
    assert (manifest["c"]["n_events"], manifest["c"]["n_sessions"], manifest["d"]["n_sessions"]) == (2, 1, 1)
    read, spans = sinks.read_inputs(spark, str(tmp_path / "x"))
    assert {(r["event_id"], r["t"]) for r in read.collect()} == {("e1", 59000.123456789012), ("e2", 1e-9)} and spans.count() == 2
    spark.createDataFrame([("c", "e3", "1.000000000000")], "campaign string, event_id string, t string").write.mode("append").csv(str(tmp_path / "x" / "events"), header=True)
    with pytest.raises(ValueError, match="c"):
        sinks.read_inputs(spark, str(tmp_path / "x"))
    assert sinks.write_csv(windows, str(tmp_path / "w")) == 2
    store = sinks.UnitStore(spark, str(tmp_path / "u"), "k string, v int", ["k"])
    units = spark.createDataFrame([("a",), ("b",)], "k string")
    assert store.pending(units).count() == 2
    store.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    store.append(spark.createDataFrame([("a", 2)], "k string, v int"))
    assert [tuple(r) for r in store.done().collect()] == [("a", 2)] and [r["k"] for r in store.pending(units).collect()] == ["b"]
    for name, value in (("s1", 1), ("s2", 2)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"k": "x", "v": value}) + "\n")
    assert [r["v"] for r in sinks.read_summaries(spark, str(tmp_path / "s*.jsonl"), "k string, v int", ["k"]).collect()] == [2]
    assert sinks.environment(spark)["spark"] == spark.version


def test_gates_and_artifacts(spark, tmp_path):
    log = tmp_path / "validation.txt"
    log.write_text("one PASS\nALL PASS: 12 checks\n\n")
    sinks.require_last_line(spark, str(log))
    log.write_text("ALL PASS\none FAIL\n")
    with pytest.raises(ValueError, match="ALL PASS"):
        sinks.require_last_line(spark, str(log))
    (tmp_path / "pin.json").write_text(json.dumps({"campaign": "c", "lam": 86.5, "aliases": [1.0, 2.0]}, indent=2))
    pin = sinks.read_artifacts(spark, str(tmp_path / "pin*.json"), "campaign string, lam double, aliases array<double>").first()
    assert (pin["campaign"], pin["lam"], pin["aliases"]) == ("c", 86.5, [1.0, 2.0]) and pin["path"].endswith("pin.json")
    astronomy.require_conversion(np.asarray([1.0, 2.0]), np.asarray([1.0 + 9e-9, 2.0]))
    with pytest.raises(ValueError, match="recorded"):
        astronomy.require_conversion(np.asarray([1.0, 2.0]), np.asarray([1.0 + 2e-8, 2.0]))


def test_text_sources(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_bytes("﻿event_id,t\nB1,1.5\nB2,2.5\n".encode())
    schema = T.StructType([T.StructField("row_index", T.StringType()), T.StructField("t", T.DoubleType())])
    assert [tuple(r) for r in text.csv_rows(spark, str(path), schema).collect()] == [("B1", 1.5), ("B2", 2.5)]
    table = tmp_path / "table.tex"
    table.write_text("20240101 & out\n\\begin{longtable}\nhead & x \\\\\n20240102 & $a\\&b$ & 3 \\\\ % note\n\\end{longtable}\n20240103 & out\n")
    rows = text.table_cells(text.text_lines(spark, str(table)), "path", "line_no", r"\\begin\{longtable\}", r"\\end\{longtable\}", r"^\s*\d{8}\s*&").collect()
    assert [r["cells"] for r in rows] == [["20240102", "a\\&b", "3"]]
    assert text.file_hashes(spark, str(path)).first()["length"] == path.stat().st_size
    counts = text.manifest_check(spark.createDataFrame([("a",), ("a",)], "k string"), spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "k string, expected int"), "k").collect()
    assert {r["k"]: r["conforms"] for r in counts} == {"a": True, "b": False, "c": True}


def test_stream_merger_equals_the_batch(spark, tmp_path):
    rows = [("c", 1, "2024-01-01 00:00:00.000", 1.0), ("c", 2, "2024-01-01 00:00:00.090", 5.0), ("c", 3, "2024-01-01 00:00:00.180", 5.0), ("c", 4, "2024-01-01 00:00:00.280", 1.0), ("d", 5, "2024-01-01 00:00:01.000", 2.0)]
    events = spark.createDataFrame(rows, "campaign string, event_id bigint, ts string, w double").selectExpr("campaign", "event_id", "cast(ts as timestamp) ts", "w")
    events.union(events.selectExpr("campaign", "event_id + 100", "ts + interval 2 hours", "w").limit(1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r["campaign"], r["event_id"], r["n_merged"]) for r in merge_stream(events).collect()}
    assert batch == {("c", 2, 3), ("c", 4, 1), ("d", 5, 1)}
    stream = merge_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["campaign"], r["event_id"], r["n_merged"]) for r in spark.sql("select * from merged").collect()} == batch


def test_arrival_times_at_the_barycentre():
    """Recorded conversion of one time, to 0.1 s; sites by coordinates and by geodetic position."""
    ra, dec = (9 + 57 / 60 + 54.69 / 3600) * 15, 68 + 49 / 60 + 0.8 / 3600
    assert abs(astronomy.barycentric(np.asarray([59593.650]), "Effelsberg", ra, dec)[0] - 59593.65434576837) * 86400 < 0.1
    assert math.dist(astronomy.site_xyz("torun"), (0, 0, 0)) == pytest.approx(6.366e6, rel=2e-3)
    with pytest.raises(KeyError):
        astronomy.site_xyz("nowhere")
