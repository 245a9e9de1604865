"""Whole studies: cleaned inputs, the confirmatory scan, null calibration and acceptance trials.

Work is dealt out as small rows of keys (campaign, octave, model, chunk; or family,
campaign, sim); a task regenerates what it needs from broadcast inputs of bounded
size and returns winners only.  Results go to a UnitStore, and a rerun does what is
missing, so a lost executor costs the units it held and a lost driver nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.astronomy import require_conversion
from tidewheel.operators import calibration, kernel
from tidewheel.operators.events import margins, merge_gaps
from tidewheel.operators.lattice import even_chunks, octave_grid
from tidewheel.operators.quantiles import exact_percentiles
from tidewheel.sources.sinks import UnitStore, require_last_line

Inputs = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
MODEL_WEIGHT = {"M2": 1.0, "M3": 5.0}
SHIPPED_VALUES = 50_000_000  # event and session times that a study may ship to every executor (400 MB)


def clean_inputs(events: DataFrame, windows: DataFrame, gap: int = 100_000, tolerance: int = 30_000_000) -> DataFrame:
    """Merged events inside or within `tolerance` of their campaign's sessions.

    Fails if a campaign would lose more than three events and more than 1 % of them.
    """
    merged = merge_gaps(events, ["campaign"], gap)
    judged = margins(merged, windows, tolerance).withColumnRenamed("near", "kept")
    lost = judged.groupBy("campaign").agg(F.count_if(~F.col("kept")).alias("lost"), F.count("*").alias("n")).filter(F.col("lost") > F.greatest(F.lit(3.0), 0.01 * F.col("n")))
    bad = lost.orderBy("campaign").limit(5).collect()
    if bad:
        raise ValueError("too many events outside sessions: " + ", ".join(f"{r['campaign']} {r['lost']} of {r['n']}" for r in bad))
    return judged.filter("kept").select("campaign", "event_id", "t", "margin")


def arrays(events: DataFrame, windows: DataFrame) -> Inputs:
    """Each campaign's sorted event days and session edges, which studies ship to all executors.

    Their number is checked first; a larger study has to be run by groups of campaigns.
    """
    size = events.count() + 2 * windows.count()
    if size > SHIPPED_VALUES:
        raise ValueError(f"{size} times are more than a study ships ({SHIPPED_VALUES}); run it by groups of campaigns")
    t = {r["campaign"]: np.asarray(r["t"]) for r in events.groupBy("campaign").agg(F.array_sort(F.collect_list("t")).alias("t")).toLocalIterator()}
    out = {}
    for r in windows.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("w")).toLocalIterator():
        out[r["campaign"]] = (t.get(r["campaign"], np.zeros(0)), np.asarray([x["a"] for x in r["w"]]), np.asarray([x["b"] for x in r["w"]]))
    return out


def scan_units(spark: SparkSession, inputs: Inputs, least_period: float = 1 / 24, sigma: float = 60 / 86400, chunk: int = 100_000, longest: float | None = None) -> DataFrame:
    """One row for each campaign, octave, model and chunk of periods, the costliest first."""
    spans = [(c, float(b[-1] - a[0]) if longest is None else min(float(b[-1] - a[0]), 3 * longest)) for c, (_, a, b) in inputs.items() if len(a)]
    octaves = octave_grid(spark.createDataFrame(spans, "campaign string, span double"), least_period, sigma)
    models = spark.createDataFrame(list(MODEL_WEIGHT.items()), "model string, weight double")
    units = even_chunks(octaves, chunk).join(F.broadcast(models))
    return units.withColumn("cost", F.col("size") * F.col("t_hi") * F.col("weight")).select("campaign", "octave", "model", "chunk", "first", "size", "t_hi", "df", "cost").orderBy(F.desc("cost"))


UNIT_SCHEMA = "campaign string, octave bigint, model string, chunk bigint, ll double, period double, sigma double, tau double, t0 double"


def run_units(units: DataFrame, inputs: Inputs, **scan) -> DataFrame:
    """The best cell of each unit, by the kernel; a unit is one row, so units spread over all tasks."""
    shared = units.sparkSession.sparkContext.broadcast(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.itertuples():
                t, a, b = shared.value[u.campaign]
                periods = 1 / (1 / u.t_hi + np.arange(u.first, u.first + u.size) * u.df)
                c = kernel.scan(t, a, b, periods, u.model == "M3", **scan)
                yield pd.DataFrame([(u.campaign, u.octave, u.model, u.chunk, *asdict(c).values())], columns=["campaign", "octave", "model", "chunk", "ll", "period", "sigma", "tau", "t0"])

    dealt = units.repartition(max(1, units.sparkSession.sparkContext.defaultParallelism * 4), "campaign", "octave", "model", "chunk")
    return dealt.mapInPandas(run, UNIT_SCHEMA)


def peaks(results: DataFrame) -> DataFrame:
    """The first best cell of each campaign, octave and model, ranked within the campaign."""
    best = results.groupBy("campaign", "octave", "model").agg(F.max(F.struct("ll", (-F.col("chunk")).alias("order"), "period", "sigma", "tau", "t0")).alias("m"))
    rows = best.select("campaign", "octave", "model", "m.ll", "m.period", "m.sigma", "m.tau", "m.t0").filter(~F.isnan("period"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("campaign").orderBy(F.desc("ll"), "octave", "model")))


def _natural(spark: SparkSession, inputs: Inputs) -> DataFrame:
    """campaign and the likelihood of each natural model, one task for each fit."""
    shared = spark.sparkContext.broadcast(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(u.campaign, u.family, calibration.fit(u.family, *shared.value[u.campaign]).ll) for u in batch.itertuples()], columns=["campaign", "family", "ll"])

    families = list(calibration.FAMILY_IDS)
    keys = spark.createDataFrame([(c, f) for c, (_, a, _) in inputs.items() if len(a) for f in families], "campaign string, family string").repartition("campaign", "family")
    return keys.mapInPandas(run, "campaign string, family string, ll double").groupBy("campaign").pivot("family", families).agg(F.first("ll"))


def confirm(spark: SparkSession, inputs: Inputs, path: str, chunk: int = 100_000, least_period: float = 1 / 24, sigma: float = 60 / 86400, validated: str | None = None, conversion: tuple[np.ndarray, np.ndarray] | None = None, **scan) -> DataFrame:
    """campaign, all six likelihoods and the statistic; resumes from what `path` holds.

    Gates come first: the report `validated` has to end in ALL PASS, and converted and
    recorded arrival times, if given, have to agree.
    """
    if validated is not None:
        require_last_line(spark, validated)
    if conversion is not None:
        require_conversion(*conversion)
    store = UnitStore(spark, path, UNIT_SCHEMA, ["campaign", "octave", "model", "chunk"])
    todo = store.pending(scan_units(spark, inputs, least_period, sigma, chunk))
    if not todo.isEmpty():
        store.append(run_units(todo, inputs, **scan))
    best = peaks(store.done()).groupBy("campaign").pivot("model", ["M2", "M3"]).agg(F.max("ll"))
    rows = _natural(spark, inputs).join(best, "campaign")
    return rows.withColumn("lam", 2 * (F.greatest("M2", "M3") - F.greatest("M0", "M1", "M4", "M5")))


def fit_nulls(spark: SparkSession, inputs: Inputs, families: Sequence[str] = tuple(calibration.FAMILY_IDS)) -> dict[tuple[str, str], calibration.Fit]:
    """The fits of each campaign and family, one task each."""
    shared = spark.sparkContext.broadcast(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.itertuples():
                f = calibration.fit(u.family, *shared.value[u.campaign])
                yield pd.DataFrame([(u.campaign, f.family, f.ll, list(f.z), [list(r) for r in f.cov], f.n_out)], columns=["campaign", "family", "ll", "z", "cov", "n_out"])

    keys = spark.createDataFrame([(c, f) for c in inputs for f in families], "campaign string, family string").repartition("campaign", "family")
    rows = keys.mapInPandas(run, "campaign string, family string, ll double, z array<double>, cov array<array<double>>, n_out int").collect()
    return {(r["campaign"], r["family"]): calibration.Fit(r["family"], r["ll"], tuple(r["z"]), tuple(map(tuple, r["cov"])), r["n_out"]) for r in rows}


SIM_SCHEMA = "family string, sim bigint, campaign string, n_events bigint, M0 double, M1 double, M4 double, M5 double, M2 double, M3 double, lam double"


def simulate_study(spark: SparkSession, inputs: Inputs, fits: dict, families: Sequence[str], first: int, last: int, periods: np.ndarray, **scan) -> DataFrame:
    """The statistic of simulations `first` to `last` - 1 of each family and campaign; the draws depend on the keys only."""
    ids = {c: i for i, c in enumerate(sorted(inputs))}
    shared = spark.sparkContext.broadcast((inputs, fits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.itertuples():
                _, a, b = shared.value[0][u.campaign]
                t = calibration.draw(shared.value[1][u.campaign, u.family], ids[u.campaign], int(u.sim), a, b)
                s = calibration.statistic(t, a, b, periods, **scan)
                yield pd.DataFrame([(u.family, u.sim, u.campaign, len(t), *(s[m] for m in ("M0", "M1", "M4", "M5", "M2", "M3", "lambda")))], columns=["family", "sim", "campaign", "n_events", "M0", "M1", "M4", "M5", "M2", "M3", "lam"])

    keys = spark.range(first, last).withColumnRenamed("id", "sim").join(spark.createDataFrame([(f, c) for f in families for c in inputs], "family string, campaign string"))
    return keys.repartition("family", "campaign", "sim").mapInPandas(run, SIM_SCHEMA)


def collate(sims: DataFrame, campaigns: int, star: float) -> DataFrame:
    """False-alarm probabilities of each family from its complete simulations.

    A simulation counts when all its campaigns are there; its statistic is the
    largest.  Percentiles are exact and linear; the 99th is given from 100
    simulations on, a family is complete from 1,000 on, and should stop if the 99th
    passes `star`.
    """
    whole = sims.groupBy("family", "sim").agg(F.count("*").alias("n"), F.max("lam").alias("lam")).filter(F.col("n") == campaigns).select("family", "lam")
    counts = whole.groupBy("family").agg(F.count("*").alias("n_sims"), F.count_if(F.col("lam") >= star).alias("n_ge"))
    rows = counts.join(exact_percentiles(whole, ["family"], "lam", {f"p{q}": q for q in (0.5, 0.9, 0.99, 0.999)}).drop("n"), "family")
    rows = rows.withColumn("fap", F.col("n_ge") / F.col("n_sims")).withColumn("p0.99", F.when(F.col("n_sims") >= 100, F.col("`p0.99`")))
    return rows.withColumns({"complete": F.col("n_sims") >= 1000, "stop": F.coalesce(F.col("`p0.99`") > star, F.lit(False))})


def acceptance(spark: SparkSession, windows: tuple[np.ndarray, np.ndarray], periods: np.ndarray, sims: int = 40, injections: int = 10, rate: float = 60.0, jitter: float = 0.0, **scan) -> dict[str, dict]:
    """Null exchangeability of each family (split-half test) and recovery of injected visits, with or without timing jitter."""
    a, b = windows
    span = float(b[-1] - a[0])

    def null(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.itertuples():
                rng = np.random.default_rng([42, 1, calibration.FAMILY_IDS[u.name], int(u.i)])
                make = {"M0": lambda r: calibration.renewal.simulate_homogeneous(r, rate, a, b), "M5": lambda r: calibration.renewal.simulate_gamma_mixed(r, 1.0, rate, a, b), "M4": lambda r: calibration.renewal.simulate_weibull(r, 0.6, rate, a, b), "M1": lambda r: calibration.renewal.simulate_two_rate(r, 2 * rate, 0.2 * rate, span / 5, span / 10, float(a[0]), a, b)}
                yield pd.DataFrame([(u.name, u.i, calibration.statistic(make[u.name](rng), a, b, periods, **scan)["lambda"])], columns=["name", "i", "value"])

    def inject(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.itertuples():
                trial, verdict = calibration.injection(u.name, int(u.i), a, b, periods, rate, jitter), None
                if trial is not None:
                    t, true = trial
                    best = max((kernel.scan(t, a, b, periods, paired, **scan) for paired in (True, False)), key=lambda c: c.ll)
                    verdict = float(calibration.recovered(t, a, b, true, best, (60 / 86400) / (4 * true.period * span)))
                yield pd.DataFrame([(u.name, u.i, verdict)], columns=["name", "i", "value"])

    def trials(names: Sequence[str], n: int, f) -> DataFrame:
        keys = spark.range(n).withColumnRenamed("id", "i").join(spark.createDataFrame([(x,) for x in names], "name string"))
        return keys.repartition("name", "i").mapInPandas(f, "name string, i bigint, value double")

    out: dict[str, dict] = {}
    rows = trials(("M0", "M1", "M4", "M5"), sims, null).toPandas().sort_values(["name", "i"])
    for name, own in rows.groupby("name"):
        x = own["value"].to_numpy()
        p = calibration.two_sample_p(x[: len(x) // 2], x[len(x) // 2 :])
        out[f"null {name}"] = {"p": p, "median": float(np.median(x)), "pass": p > 0.01}
    found = trials(("M2", "M3"), injections, inject).filter("value is not null").groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("share")).collect()
    for r in found:
        out[f"recovery {r['name']}"] = {"n": r["n"], "share": r["share"], "pass": r["share"] >= 0.9}
    return out
