"""Queries of the session models, the statistic, aliases and calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import likelihood, special, timeaxis
from tidewheel.operators import alias, calibration, kernel, renewal
from tidewheel.operators import events as ops
from tidewheel.operators import lattice as lat
from tidewheel.operators.quantiles import exact_percentiles
from tidewheel.plans import frames, phases
from tidewheel.plans.frames import EVENTS_SQL, OBSERVED_SQL, WINDOWS_SQL, pos_mod
from tidewheel.sources.shared import cut

Q: dict = {}
SQL: dict[str, str] = {}

DAY = phases.DAY
SHAPE = 0.7
_GAMMA = math.gamma(1 + 1 / SHAPE)
ALPHA = 1.5
STEP = 0.02


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _day(column) -> F.Column:
    return column / F.lit(float(timeaxis.DAY_US))


_RATE_SQL = f"rt AS (SELECT n.campaign, n / live AS rate FROM (SELECT campaign, count(*) AS n FROM ob GROUP BY 1) n JOIN (SELECT campaign, sum(b - a) / {DAY} AS live FROM win GROUP BY 1) l ON n.campaign = l.campaign)"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    n = frames.observed(spark, d).groupBy("campaign").agg(F.count("*").alias("n"))
    return n.join(phases.live_time(spark, d), "campaign").select("campaign", (F.col("n") / _day(F.col("live_us"))).alias("rate"))


@query(
    f"WITH {OBSERVED_SQL}, {_RATE_SQL}, g AS (SELECT ob.campaign, ob.session, rate, rate * {_GAMMA!r}::DOUBLE AS pace, greatest((t - lag(t) OVER w) / {DAY}, 1e-9) AS gap, CASE WHEN row_number() OVER w = 1 THEN greatest((t - a) / {DAY}, 1e-9) END AS first_gap, CASE WHEN lead(t) OVER w IS NULL THEN greatest((b - t) / {DAY}, 1e-9) END AS tail FROM ob JOIN rt USING (campaign) WINDOW w AS (PARTITION BY ob.campaign, ob.session ORDER BY t, event_id)) "
    f"SELECT campaign, count(DISTINCT session) AS n_sessions, round(sum(CASE WHEN first_gap IS NOT NULL THEN ln(rate) - power(first_gap * pace, {SHAPE}) ELSE ln({SHAPE}::DOUBLE / gap) + {SHAPE}::DOUBLE * ln(gap * pace) - power(gap * pace, {SHAPE}) END - CASE WHEN tail IS NULL THEN 0 ELSE power(tail * pace, {SHAPE}) END), 4) AS ll FROM g GROUP BY campaign"
)
def m4_ll_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Weibull renewal at a fixed shape over the sessions that have events."""
    rows = _weibull_terms(frames.observed(spark, d).join(_rates(spark, d), "campaign"))
    return rows.groupBy("campaign").agg(F.count_distinct("session").alias("n_sessions"), F.round(F.sum("ll"), 4).alias("ll"))


def _weibull_terms(rows: DataFrame) -> DataFrame:
    """campaign, session and each event's part `ll` of the renewal likelihood; a session starts anew."""
    order = Window.partitionBy("campaign", "session").orderBy("t", "event_id")
    rows = rows.withColumn("pace", F.col("rate") * _GAMMA).withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order)})
    shape, pace, least = F.lit(SHAPE), F.col("pace"), F.lit(renewal.SHORTEST_GAP)
    gap, first, tail = F.greatest(_day(F.col("t") - F.col("before")), least), F.greatest(_day(F.col("t") - F.col("a")), least), F.greatest(_day(F.col("b") - F.col("t")), least)
    opening = F.log("rate") + likelihood.weibull_log_survival(first, shape, pace)
    term = F.when(F.col("before").isNull(), opening).otherwise(likelihood.weibull_log_density(gap, shape, pace))
    closing = F.when(F.col("after").isNull(), likelihood.weibull_log_survival(tail, shape, pace)).otherwise(0.0)
    return rows.select("campaign", "session", (term + closing).alias("ll"))


_S = 1 / SHAPE
_UPPER_SQL = (
    f"CASE WHEN x < {_S + 1!r}::DOUBLE THEN 1 - exp({_S!r}::DOUBLE * ln(greatest(x, 1e-300)) - x) / {math.gamma(_S + 1)!r}::DOUBLE * list_reduce(list_prepend(1.0::DOUBLE, [n::DOUBLE FOR n IN range({likelihood.TERMS}, 0, -1)]), lambda acc, n: 1 + x / (n + {_S!r}::DOUBLE) * acc) "
    f"ELSE exp({_S!r}::DOUBLE * ln(x) - x) / {math.gamma(_S)!r}::DOUBLE / list_reduce(list_prepend(x + {2 * likelihood.TERMS + 1 - _S!r}::DOUBLE, [n::DOUBLE FOR n IN range({likelihood.TERMS}, 0, -1)]), lambda acc, n: x + (2 * n - 1 - {_S!r}::DOUBLE) - n * (n - {_S!r}::DOUBLE) / acc) END"
)
_M4_SQL = (
    f"SELECT campaign, n_sessions, round(coalesce(held.ll, 0) + coalesce(bare, 0), 4) AS ll FROM (SELECT win.campaign, count(*) AS n_sessions FROM win GROUP BY 1) n LEFT JOIN ({SQL['m4_ll_sessions'].replace('round(sum(', '(sum(').replace(', 4) AS ll', ') AS ll').replace('SELECT campaign, count(DISTINCT session) AS n_sessions,', 'SELECT campaign,')}) held USING (campaign) "
    f"LEFT JOIN (SELECT campaign, sum(ln(greatest({_UPPER_SQL}, 1e-300))) AS bare FROM (SELECT win.campaign, power((b - a) / {DAY} * rate * {_GAMMA!r}::DOUBLE, {SHAPE}) AS x FROM win JOIN rt USING (campaign) WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.campaign = win.campaign AND ob.session = win.session)) GROUP BY 1) e USING (campaign)"
)


@query(f"WITH {OBSERVED_SQL}, {_RATE_SQL} {_M4_SQL}")
def m4_ll(spark: SparkSession, d: str) -> DataFrame:
    """Weibull renewal at a fixed shape over all sessions; one without events has the chance of a wait at least as long."""
    rates = _rates(spark, d)
    held = _weibull_terms(frames.observed(spark, d).join(rates, "campaign"))
    windows = frames.windows(spark, d)
    empty = windows.join(frames.observed(spark, d).select("campaign", "session").distinct(), ["campaign", "session"], "left_anti").join(rates, "campaign")
    wait = F.pow(_day(F.col("b") - F.col("a")) * F.col("rate") * _GAMMA, F.lit(SHAPE))
    bare = empty.select("campaign", F.log(F.greatest(likelihood.gamma_upper(1 / SHAPE, wait), F.lit(renewal.FLOOR))).alias("ll"))
    ll = held.select("campaign", "ll").unionByName(bare).groupBy("campaign").agg(F.sum("ll").alias("ll"))
    counts = windows.groupBy("campaign").agg(F.count("*").alias("n_sessions"))
    return counts.join(ll, "campaign", "left").select("campaign", "n_sessions", F.round(F.coalesce("ll", F.lit(0.0)), 4).alias("ll"))


_M5_SQL = (
    f"WITH {OBSERVED_SQL}, {_RATE_SQL}, s AS (SELECT win.campaign, win.session, (any_value(win.b) - any_value(win.a)) / {DAY} AS w, count(ob.event_id) AS n, any_value(rate) / {ALPHA}::DOUBLE AS beta FROM win JOIN rt ON rt.campaign = win.campaign LEFT JOIN ob ON ob.campaign = win.campaign AND ob.session = win.session GROUP BY ALL), "
    "p AS (SELECT *, beta * w / (1 + beta * w) AS p FROM s) "
    f"SELECT campaign, count(*) AS n_sessions, round(sum(lgamma(n + {ALPHA}::DOUBLE) - lgamma({ALPHA}::DOUBLE) + {ALPHA}::DOUBLE * ln(1 - p) + CASE WHEN n = 0 THEN 0 ELSE n * ln(p) - n * ln(w) END), 4) AS ll FROM p GROUP BY campaign"
)


@query(_M5_SQL)
def m5_ll(spark: SparkSession, d: str) -> DataFrame:
    """Gamma-mixed Poisson at a fixed dispersion over all sessions."""
    n = frames.observed(spark, d).groupBy("campaign", "session").agg(F.count("*").alias("n"))
    rows = frames.windows(spark, d).join(n, ["campaign", "session"], "left").join(_rates(spark, d), "campaign")
    ll = likelihood.negative_binomial(F.coalesce("n", F.lit(0)), _day(F.col("b") - F.col("a")), F.lit(ALPHA), F.col("rate") / ALPHA)
    return rows.groupBy("campaign").agg(F.count("*").alias("n_sessions"), F.round(F.sum(ll), 4).alias("ll"))


def _model_sql(name: str, column: str) -> str:
    return f"(SELECT campaign, ll AS {column} FROM ({phases.SQL[name] if name in phases.SQL else SQL[name]}))"


_LAMBDA_SQL = (
    "SELECT campaign, m0, m1, m2, m3, m4, m5, round(2 * (greatest(m2, m3) - greatest(m0, m1, m4, m5)), 3) AS lam FROM "
    + " JOIN ".join(f"{_model_sql(name, column)} {column}_t" + (" USING (campaign)" if i else "") for i, (name, column) in enumerate((("m0_ll", "m0"), ("m1_scan", "m1"), ("m2_scan", "m2"), ("m3_scan", "m3"), ("m4_ll", "m4"), ("m5_ll", "m5"))))
)


def _visit_models(spark: SparkSession, d: str) -> DataFrame:
    """campaign, m1, m2 and m3: the three lattices are one union, so events and sessions are read, folded and counted once."""
    apart = 1_000  # period numbers of the activity windows, beyond those of the visits
    columns = [*lat.KEY, "period_us", "h", "n_t0", "visits"]
    rows = reduce(DataFrame.unionByName, (phases._single(spark, d).select(columns), phases._pairs(spark, d).select(columns), phases._activity(spark, d).withColumn("period_id", F.col("period_id") + apart).select(columns)))
    model = F.when(F.col("period_id") >= apart, "m1").when(F.col("tau_id") < 0, "m2").otherwise("m3")
    best = phases._cells(spark, d, rows).filter(~F.isnan("ll")).groupBy("campaign").agg(*[F.max(F.when(model == m, F.col("ll"))).alias(m) for m in ("m1", "m2", "m3")])
    return best


@query(_LAMBDA_SQL)
def lambda_stat(spark: SparkSession, d: str) -> DataFrame:
    """Twice the gain of the best visit model over the best natural one, the session models at fixed shapes (lambda_full fits them)."""
    rows = _visit_models(spark, d)
    for name, f in (("m0", phases.m0_ll), ("m4", m4_ll), ("m5", m5_ll)):
        rows = rows.join(f(spark, d).select("campaign", F.col("ll").alias(name)), "campaign")
    rows = rows.select("campaign", "m0", "m1", "m2", "m3", "m4", "m5")
    return rows.withColumn("lam", F.round(2 * (F.greatest("m2", "m3") - F.greatest("m0", "m1", "m4", "m5")), 3))


@query(f"SELECT max(lam) AS lam, arg_max(campaign, lam) AS campaign FROM ({_LAMBDA_SQL})")
def study_max(spark: SparkSession, d: str) -> DataFrame:
    best = lambda_stat(spark, d).agg(F.max(F.struct("lam", "campaign")).alias("m"))
    return best.select("m.lam", "m.campaign")


def _peak_sql(model: str, lattice: str) -> str:
    return f"SELECT campaign, '{model}' AS model, octave, period_id, ll FROM (SELECT *, period_id // 2 AS octave, row_number() OVER (PARTITION BY campaign, period_id // 2 ORDER BY ll DESC, period_id, sigma_id, tau_id, i) AS rn FROM (WITH {phases._scan_sql(lattice)} SELECT * FROM cells)) WHERE rn = 1"


_PEAKS_SQL = f"{_peak_sql('M2', phases._L2_SQL)} UNION ALL {_peak_sql('M3', phases._L3_SQL)}"


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for model, rows in (("M2", phases._single(spark, d)), ("M3", phases._pairs(spark, d))):
        cells = phases._cells(spark, d, rows).withColumn("octave", F.call_function("div", F.col("period_id"), F.lit(2)))
        best = lat.first_best(cells.select("campaign", "octave", *phases._ORDER, "ll"), ["campaign", "octave"], phases._ORDER)
        best = best.select("campaign", F.lit(model).alias("model"), "octave", "period_id", "ll")
        found = best if found is None else found.unionByName(best)
    return found


@query(f"SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY ll DESC, octave, model) AS place FROM ({_PEAKS_SQL})")
def rank_peaks(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("campaign").orderBy(F.desc("ll"), "octave", "model")
    return _peaks(spark, d).withColumn("place", F.row_number().over(order).cast("bigint"))


_RATIONALS_SQL = "SELECT DISTINCT round(n * (p / q) * turn, 9) AS f FROM (SELECT unnest([1, 2]) AS n), (SELECT unnest([1.0::DOUBLE, 2, 3]) AS p), (SELECT unnest([1.0::DOUBLE, 2, 3]) AS q), (SELECT unnest([1.0::DOUBLE / 0.99726957::DOUBLE, 1.0]) AS turn)"


@query(f"WITH sp AS ({phases.SQL['campaign_span']}), ra AS ({_RATIONALS_SQL}) SELECT campaign, f FROM sp, ra WHERE f > 3 / (span_us / {DAY})")
def alias_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """The day-rational frequencies that lie above the lowest frequency each campaign's span can show."""
    spans = phases.campaign_span(spark, d).withColumn("span", _day(F.col("span_us")))
    return spans.join(F.broadcast(alias.day_rationals(spark))).filter(F.col("f") > 3 / F.col("span")).select("campaign", "f")


_N_F = 400
_PI2 = f"{2 * math.pi!r}::DOUBLE"
_POWER_SQL = (
    f"fr AS (SELECT i, i * {STEP}::DOUBLE AS f FROM (SELECT unnest(range(0, {_N_F}))::BIGINT AS i)), "
    f"sm AS (SELECT campaign, i, f, sum((sin({_PI2} * f * (b / {DAY})) - sin({_PI2} * f * (a / {DAY}))) / CASE WHEN f = 0 THEN 1 ELSE {_PI2} * f END) AS re, sum((cos({_PI2} * f * (a / {DAY})) - cos({_PI2} * f * (b / {DAY}))) / CASE WHEN f = 0 THEN 1 ELSE {_PI2} * f END) AS im, sum(b / {DAY} - a / {DAY}) AS live FROM win, fr GROUP BY ALL), "
    "pw AS (SELECT campaign, i, f, round((re * re + im * im) / (live * live), 6) AS power FROM sm)"
)


def _power(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(_N_F).select(F.col("id").alias("i"), (F.col("id") * STEP).alias("f"))
    rows = alias.spectral_power(frames.windows(spark, d), frames.campaigns(spark, d).select("campaign").join(F.broadcast(grid)))
    return rows.withColumn("power", F.round("power", 6))


@query(f"WITH {WINDOWS_SQL}, {_POWER_SQL} SELECT campaign, i, round(f, 6) AS f, power FROM pw")
def spectral_window(spark: SparkSession, d: str) -> DataFrame:
    return _power(spark, d).select("campaign", "i", F.round("f", 6).alias("f"), "power")


_LEAST = 0.02
_RUNS_SQL = f"rs AS (SELECT campaign, i, f, power, i - row_number() OVER (PARTITION BY campaign ORDER BY i) AS island FROM pw WHERE power > {_LEAST}), rn AS (SELECT campaign, min(i) AS lo, max(i) AS hi, count(*) AS n_points, max(power) AS max_value, min(CASE WHEN power = m THEN i END) AS at_max FROM (SELECT *, max(power) OVER (PARTITION BY campaign, island) AS m FROM rs) GROUP BY campaign, island)"


@query(f"WITH {WINDOWS_SQL}, {_POWER_SQL}, {_RUNS_SQL} SELECT * FROM rn")
def peak_runs(spark: SparkSession, d: str) -> DataFrame:
    return lat.runs(_power(spark, d), ["campaign"], "i", "power", _LEAST)


_DILATED_SQL = f"dl AS (SELECT *, max(CASE WHEN power > {_LEAST} THEN 1 ELSE 0 END) OVER (PARTITION BY campaign ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM pw)"


@query(f"WITH {WINDOWS_SQL}, {_POWER_SQL}, {_DILATED_SQL} SELECT campaign, i, near FROM dl")
def flag_dilate(spark: SparkSession, d: str) -> DataFrame:
    return alias.dilate(_power(spark, d), "campaign", "i", F.col("power") > _LEAST, 2).select("campaign", "i", "near")


@query(f"WITH {WINDOWS_SQL}, {_POWER_SQL}, {_DILATED_SQL} SELECT campaign, i // 50 AS octave, count(*) AS n_f, count(*) FILTER (power > {_LEAST}) AS n_peak_points, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 6) AS flagged_frac FROM dl GROUP BY ALL")
def octave_alias_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = alias.dilate(_power(spark, d), "campaign", "i", F.col("power") > _LEAST, 2).withColumn("octave", F.call_function("div", F.col("i"), F.lit(50)))
    return rows.groupBy("campaign", "octave").agg(F.count("*").alias("n_f"), F.count_if(F.col("power") > _LEAST).alias("n_peak_points"), F.round(F.avg(F.col("near").cast("double")), 6).alias("flagged_frac"))


_TOL = 2 / 29
_CANDIDATES_SQL = "pk AS (SELECT campaign, k AS peak_id, 0.15::DOUBLE + k * 0.37::DOUBLE AS f FROM cp, (SELECT unnest(range(0, 16))::BIGINT AS k))"
_RATIONAL_SQL = f"ra AS ({_RATIONALS_SQL})"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    k = spark.range(16).select(F.col("id").alias("peak_id"), (F.lit(0.15) + F.col("id") * 0.37).alias("f"))
    return frames.campaigns(spark, d).select("campaign").join(F.broadcast(k)).withColumn("tol", F.lit(_TOL))


@query(f"WITH {WINDOWS_SQL}, {_POWER_SQL}, {_CANDIDATES_SQL}, {_RATIONAL_SQL} SELECT campaign, peak_id, EXISTS (SELECT 1 FROM ra WHERE abs(pk.f - ra.f) < {_TOL!r}::DOUBLE) OR EXISTS (SELECT 1 FROM pw WHERE pw.campaign = pk.campaign AND power > {_LEAST} AND pw.f <= greatest(3.0, 1.5 * pk.f) AND abs(pw.f - pk.f) < {_TOL!r}::DOUBLE) AS flagged FROM pk")
def alias_flag_live(spark: SparkSession, d: str) -> DataFrame:
    """Candidates near a day-rational or near a point of the campaign's own spectral window above the threshold."""
    points = _power(spark, d).filter(F.col("power") > _LEAST).select(F.col("campaign").alias("c"), F.col("f").alias("fp"))
    rows = _candidates(spark, d)
    rational = alias.flag_peaks(rows, alias.day_rationals(spark), points.select(F.col("c").alias("campaign"), F.col("fp").alias("f_lo"), F.col("fp").alias("f_hi")).filter(F.lit(False)))
    near = rows.join(points, (F.col("campaign") == F.col("c")) & (F.col("fp") <= F.greatest(F.lit(3.0), 1.5 * F.col("f"))) & (F.abs(F.col("fp") - F.col("f")) < F.col("tol")), "left_semi").select("campaign", "peak_id", F.lit(True).alias("near"))
    return rational.join(near, ["campaign", "peak_id"], "left").select("campaign", "peak_id", (F.col("source").isNotNull() | F.coalesce("near", F.lit(False))).alias("flagged"))


@query(
    f"WITH {WINDOWS_SQL}, {_POWER_SQL}, {_RUNS_SQL}, {_CANDIDATES_SQL}, {_RATIONAL_SQL} SELECT campaign, peak_id, CASE WHEN EXISTS (SELECT 1 FROM ra WHERE abs(pk.f - ra.f) < 0.03::DOUBLE) THEN 'day_rational' WHEN EXISTS (SELECT 1 FROM rn WHERE rn.campaign = pk.campaign AND pk.f >= rn.lo * {STEP}::DOUBLE - 0.03::DOUBLE AND pk.f <= rn.hi * {STEP}::DOUBLE + 0.03::DOUBLE) THEN 'window_peak' END AS source FROM pk"
)
def alias_flag_peaks(spark: SparkSession, d: str) -> DataFrame:
    intervals = lat.runs(_power(spark, d), ["campaign"], "i", "power", _LEAST).select("campaign", (F.col("lo") * STEP).alias("f_lo"), (F.col("hi") * STEP).alias("f_hi"))
    return alias.flag_peaks(_candidates(spark, d).withColumn("tol", F.lit(0.03)), alias.day_rationals(spark), intervals).select("campaign", "peak_id", "source")


@query(
    f"WITH {EVENTS_SQL}, s AS (SELECT campaign, (max(t) - min(t)) / {DAY} AS sep FROM ev GROUP BY 1) SELECT campaign, k, round(sep / (0.7::DOUBLE + k), 6) AS ratio, CAST(round(sep / (0.7::DOUBLE + k)) AS BIGINT) AS nearest, round(abs(sep / (0.7::DOUBLE + k) - round(sep / (0.7::DOUBLE + k))) / (sep / (0.7::DOUBLE + k)), 6) AS deviation FROM s, (SELECT unnest(range(0, 8))::BIGINT AS k)"
)
def subharmonic_ratio(spark: SparkSession, d: str) -> DataFrame:
    sep = frames.events(spark, d).groupBy("campaign").agg(_day(F.max("t") - F.min("t")).alias("sep"))
    rows = sep.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")))).withColumn("n", F.col("sep") / (0.7 + F.col("k")))
    return rows.select("campaign", "k", F.round("n", 6).alias("ratio"), F.round("n").cast("bigint").alias("nearest"), F.round(F.abs(F.col("n") - F.round("n")) / F.col("n"), 6).alias("deviation"))


@query(
    f"WITH b AS ({phases.SQL['m2_scan']}), l AS ({phases.SQL['live_time']}), n AS ({phases.SQL['m0_ll']}), {phases._GRID_SQL}, r AS (SELECT b.campaign, (n_in / (e_us / {DAY})) AS lam_v, ((n - n_in) / ((live_us - e_us) / {DAY})) AS lam_b, sigma / T::DOUBLE AS duty FROM b JOIN l ON l.campaign = b.campaign JOIN n ON n.campaign = b.campaign JOIN per ON per.period_id = b.period_id JOIN sig ON sig.sigma_id = b.sigma_id) "
    "SELECT campaign, round(duty, 6) AS duty, round(lam_v * duty / (lam_b * (1 - duty)) / (1 + lam_v * duty / (lam_b * (1 - duty))), 6) AS p_in, round(power(1 - lam_v * duty / (lam_b * (1 - duty)) / (1 + lam_v * duty / (lam_b * (1 - duty))), 7), 6) AS p_none FROM r"
)
def out_of_sample_fold(spark: SparkSession, d: str) -> DataFrame:
    """The chance that a new detection falls in the best visit, and that none of seven does."""
    t = spark.createDataFrame(list(enumerate(phases.PERIODS)), "period_id bigint, period_us bigint")
    s = spark.createDataFrame(list(enumerate(phases.SIGMAS)), "sigma_id bigint, sigma bigint")
    rows = phases.m2_scan(spark, d).join(phases.live_time(spark, d), "campaign").join(phases.m0_ll(spark, d).select("campaign", "n"), "campaign").join(F.broadcast(t), "period_id").join(F.broadcast(s), "sigma_id")
    duty = F.col("sigma") / F.col("period_us")
    inside, outside = F.col("n_in") / _day(F.col("e_us")), (F.col("n") - F.col("n_in")) / _day(F.col("live_us") - F.col("e_us"))
    odds = inside * duty / (outside * (1 - duty))
    p = odds / (1 + odds)
    return rows.select("campaign", F.round(duty, 6).alias("duty"), F.round(p, 6).alias("p_in"), F.round(F.pow(1 - p, F.lit(7)), 6).alias("p_none"))


_STAR = 120.0


@query(
    f"WITH f AS (SELECT event_type AS family, count(*) AS n_sims, count(*) FILTER (value >= {_STAR}) AS n_ge, round(avg(CASE WHEN value >= {_STAR} THEN 1.0 ELSE 0.0 END), 8) AS fap, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, CASE WHEN count(*) >= 100 THEN round(quantile_cont(value, 0.99), 6) END AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY 1) "
    f"SELECT *, n_sims >= 1000 AS stage1_complete, coalesce(p99 > {_STAR}, false) AS stop_rule, max(CASE WHEN n_sims >= 1000 THEN fap END) OVER () AS fap_conservative FROM f"
)
def fap_collate(spark: SparkSession, d: str) -> DataFrame:
    """False-alarm probability and percentiles of each family; the conservative one is the largest of the complete families."""
    sims = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("family"), "value")
    found = sims.groupBy("family").agg(F.count("*").alias("n_sims"), F.count_if(F.col("value") >= _STAR).alias("n_ge"), F.round(F.avg((F.col("value") >= _STAR).cast("double")), 8).alias("fap"))
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    found = found.join(exact_percentiles(sims, ["family"], "value", shares).select("family", *[F.round(c, 6).alias(c) for c in shares]), "family", "left")
    found = found.withColumn("p99", F.when(F.col("n_sims") >= 100, F.col("p99"))).withColumns({"stage1_complete": F.col("n_sims") >= 1000, "stop_rule": F.coalesce(F.col("p99") > _STAR, F.lit(False))})
    return found.withColumn("fap_conservative", F.max(F.when(F.col("stage1_complete"), F.col("fap"))).over(Window.partitionBy()))


@query(
    "WITH h AS (SELECT event_type AS family, value, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= count(*) OVER (PARTITION BY event_type) // 2 THEN 1 ELSE 0 END AS first FROM events), "
    "v AS (SELECT family, value, sum(first) AS n1, count(*) - sum(first) AS n2 FROM h GROUP BY ALL), "
    "c AS (SELECT family, abs(sum(n1) OVER w / sum(n1) OVER p - sum(n2) OVER w / sum(n2) OVER p) AS d FROM v WINDOW w AS (PARTITION BY family ORDER BY value), p AS (PARTITION BY family)) "
    "SELECT family, round(max(d), 9) AS d FROM c GROUP BY family"
)
def ks_two_sample_d(spark: SparkSession, d: str) -> DataFrame:
    """Largest distance between the distributions of the first and the second half, ties taken together."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("family"), "value", "event_id")
    rows = rows.withColumns({ops.BUCKET: F.call_function("div", F.col("event_id"), F.lit(4096)), "one": F.lit(1)})
    half = rows.groupBy("family").agg(F.call_function("div", F.count("*"), F.lit(2)).alias("half"))
    ranked = ops.running_totals(rows, ["family"], ["event_id"], ["one"]).join(half, "family").withColumn("first", (F.col("upto_one") <= F.col("half")).cast("bigint"))
    steps = ranked.groupBy("family", "value").agg(F.sum("first").alias("n1"), (F.count("*") - F.sum("first")).alias("n2"))
    steps = steps.withColumn(ops.BUCKET, F.floor("value"))
    totals = steps.groupBy("family").agg(F.sum("n1").alias("all1"), F.sum("n2").alias("all2"))
    upto = ops.running_totals(steps, ["family"], ["value"], ["n1", "n2"]).join(totals, "family")
    gap = F.abs(F.col("upto_n1") / F.col("all1") - F.col("upto_n2") / F.col("all2"))
    return upto.groupBy("family").agg(F.round(F.max(gap), 9).alias("d"))


_H = frames.HOUR_US


@query(
    f"WITH {OBSERVED_SQL}, m AS (SELECT campaign, {pos_mod('t', str(26 * _H))} < {12 * _H} AS truth, {pos_mod(f't - {_H}', str(26 * _H))} < {12 * _H} AS hat FROM ob) SELECT campaign, count(*) FILTER (truth AND hat) AS n_both, count(*) FILTER (truth OR hat) AS n_either, round(count(*) FILTER (truth AND hat) / count(*) FILTER (truth OR hat)::DOUBLE, 9) AS jaccard FROM m GROUP BY campaign HAVING count(*) FILTER (truth OR hat) > 0"
)
def mask_jaccard(spark: SparkSession, d: str) -> DataFrame:
    truth = timeaxis.phase(F.col("t"), F.lit(0), F.lit(26 * _H)) < 12 * _H
    hat = timeaxis.phase(F.col("t"), F.lit(_H), F.lit(26 * _H)) < 12 * _H
    rows = frames.observed(spark, d).groupBy("campaign").agg(F.count_if(truth & hat).alias("n_both"), F.count_if(truth | hat).alias("n_either")).filter("n_either > 0")
    return rows.withColumn("jaccard", F.round(F.col("n_both") / F.col("n_either"), 9))


@query("SELECT event_type AS model, count(*) AS n_trials, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 9) AS recovered, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) >= 0.9 AS passes FROM events WHERE user_id % 11 <> 0 GROUP BY 1")
def recovery_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of recovered trials; trials without a verdict are left out."""
    verdict = F.when(F.col("user_id") % 11 != 0, (F.col("value") > 20).cast("double"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("model"), verdict.alias("v")).filter("v is not null")
    return rows.groupBy("model").agg(F.count("v").alias("n_trials"), F.round(F.avg("v"), 9).alias("recovered"), (F.avg("v") >= 0.9).alias("passes"))


@query("WITH k AS (SELECT DISTINCT event_type, user_id % 1000 AS sim, epoch_us(ts) // 86400000000 % 2 AS part FROM events) SELECT sim, count(*) AS n_units FROM k GROUP BY sim HAVING count(*) = 10")
def complete_sims_only(spark: SparkSession, d: str) -> DataFrame:
    """Simulations all of whose units (campaign by part) are done."""
    day = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(timeaxis.DAY_US)) % 2
    units = spark.read.parquet(f"{d}/events.parquet").select("event_type", (F.col("user_id") % 1000).alias("sim"), day.alias("part")).distinct()
    return units.groupBy("sim").agg(F.count("*").alias("n_units")).filter("n_units = 10")


# --- kernels: no SQL form; tested against direct computation -----------------


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """One row a campaign: its sessions' starts, ends (days) and numbers of events, which the calendar bounds, and its place by name."""
    n = frames.observed(spark, d).groupBy("campaign", "session").agg(F.count("*").alias("n"))
    rows = frames.windows(spark, d).join(n, ["campaign", "session"], "left")
    spans = rows.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    days = F.transform("w", lambda x: F.struct(_day(x["a"]).alias("a"), _day(x["b"]).alias("b"), x["n"].alias("n")))
    place = F.row_number().over(Window.orderBy("campaign")) - 1
    return spans.select("campaign", days["a"].alias("a"), days["b"].alias("b"), F.col("w.n").alias("n"), place.alias("place"))


SIMS = 20


def _simulated(spark: SparkSession, d: str, family: str) -> DataFrame:
    """campaign, sim, n_events, first and last day of seeded streams; the seed is the key, so partitions don't matter."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                a, b, n = np.asarray(row.a), np.asarray(row.b), int(np.sum(row.n))
                rng = np.random.default_rng([calibration.SEED, calibration.FAMILY_IDS[family], row.place, row.sim])
                rate = max(n, 1) / float(np.sum(b - a))
                if family == "M0":
                    s = renewal.simulate_homogeneous(rng, rate, a, b)
                elif family == "M1":
                    s = renewal.simulate_two_rate(rng, 2 * rate, 0.5 * rate, 5.0, 2.0, float(a[0]), a, b)
                elif family == "M4":
                    s = renewal.simulate_weibull(rng, SHAPE, rate, a, b)
                else:
                    s = renewal.simulate_gamma_mixed(rng, ALPHA, rate / ALPHA, a, b)
                out.append((row.campaign, row.sim, len(s), float(s[0]) if len(s) else None, float(s[-1]) if len(s) else None))
            yield pd.DataFrame(out, columns=["campaign", "sim", "n_events", "first_day", "last_day"])

    keys = _sessions(spark, d).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(SIMS - 1)))).repartition("campaign", "sim")
    return keys.mapInPandas(draw, "campaign string, sim int, n_events bigint, first_day double, last_day double")


@query()
def simulate_m0(spark: SparkSession, d: str) -> DataFrame:
    return _simulated(spark, d, "M0")


@query()
def simulate_m1(spark: SparkSession, d: str) -> DataFrame:
    return _simulated(spark, d, "M1")


@query()
def simulate_m4(spark: SparkSession, d: str) -> DataFrame:
    return _simulated(spark, d, "M4")


@query()
def simulate_m5(spark: SparkSession, d: str) -> DataFrame:
    return _simulated(spark, d, "M5")


def _waits(spark: SparkSession, d: str) -> DataFrame:
    """campaign, wait (days) and whether it lies between two events, for each wait within a session."""
    order = Window.partitionBy("campaign", "session").orderBy("t", "event_id")
    rows = frames.observed(spark, d).withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order)})
    between = F.struct((F.col("t") - F.coalesce("before", "a")).alias("us"), F.col("before").isNotNull().alias("inner"))
    tail = F.when(F.col("after").isNull(), F.struct((F.col("b") - F.col("t")).alias("us"), F.lit(False).alias("inner")))
    waits = rows.select("campaign", F.explode(F.array_compact(F.array(between, tail))).alias("x"))
    return waits.select("campaign", F.greatest(_day(F.col("x.us")), F.lit(renewal.SHORTEST_GAP)).alias("wait"), F.col("x.inner").alias("inner"))


LADDER, LADDER_ROUNDS = 24, 4


def _at_shapes(waits: DataFrame, sessions: DataFrame, shapes: DataFrame) -> DataFrame:
    """The sums of `renewal.Waits` for each of a campaign's `LADDER` shapes: one map-side-combined aggregate over its waits."""
    rows = waits.join(shapes.select("campaign", "shapes"), "campaign")
    log = F.log("wait")
    powers = F.array(*[F.sum(F.exp(F.element_at("shapes", i + 1) * log)) for i in range(LADDER)])
    sums = rows.groupBy("campaign").agg(F.count_if("inner").alias("gaps"), F.sum(F.when(F.col("inner"), log)).alias("log_gaps"), powers.alias("powers"))
    return sessions.join(shapes, "campaign").join(sums, "campaign", "left")


def _sums(row, i: int) -> renewal.Waits:
    n, w = np.asarray(row.n), np.asarray(row.b) - np.asarray(row.a)
    some = row.powers is not None
    return renewal.Waits(float(np.sum(n > 0)), float(row.gaps or 0) if some else 0.0, float(row.log_gaps or 0) if some and row.gaps else 0.0, float(row.powers[i]) if some else 0.0, w[n == 0])


def _profiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best of a campaign's shapes with its rate, and the shapes between its neighbours for the next round."""
    for batch in batches:
        out = []
        for row in batch.itertuples():
            live = float(np.sum(np.asarray(row.b) - np.asarray(row.a)))
            found = [_sums(row, i).best_rate(k, max(1, np.sum(row.n)) / live) for i, k in enumerate(row.shapes)]
            i = int(np.argmax([ll for _, ll in found]))
            low, high = row.shapes[max(0, i - 1)], row.shapes[min(LADDER - 1, i + 1)]
            out.append((row.campaign, np.geomspace(low, high, LADDER), float(row.shapes[i]), *map(float, found[i])))
        yield pd.DataFrame(out, columns=["campaign", "shapes", "p", "q", "ll"])


def _weibull_fits(spark: SparkSession, d: str, sessions: DataFrame | None = None) -> DataFrame:
    """campaign, shape p, rate q and ll of the renewal model: a ladder of shapes, refined about the best, with the rate worked out at each."""
    waits, sessions = cut(_waits(spark, d)), cut(_sessions(spark, d)) if sessions is None else sessions  # read in each round
    ladder = F.array(*[F.lit(float(k)) for k in np.geomspace(0.05, 5.0, LADDER)])
    best = sessions.select("campaign", ladder.alias("shapes"))
    for _ in range(LADDER_ROUNDS):
        best = _at_shapes(waits, sessions, best.select("campaign", "shapes")).mapInPandas(_profiled, "campaign string, shapes array<double>, p double, q double, ll double")
    return best.select("campaign", F.lit("M4").alias("family"), "p", "q", "ll")


def _gamma_fits(spark: SparkSession, d: str, sessions: DataFrame | None = None) -> DataFrame:
    """campaign, alpha p, beta q and ll of the gamma-mixed model, from the sessions' counts."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                n, w = np.asarray(row.n), np.asarray(row.b) - np.asarray(row.a)
                out.append((row.campaign, "M5", *renewal.fit_gamma_counts(n, w, max(1, int(n.sum())) / float(w.sum()))))
            yield pd.DataFrame(out, columns=["campaign", "family", "p", "q", "ll"])

    return (_sessions(spark, d) if sessions is None else sessions).repartition("campaign").mapInPandas(fit, "campaign string, family string, p double, q double, ll double")


@query()
def fit_m4(spark: SparkSession, d: str) -> DataFrame:
    return _weibull_fits(spark, d)


@query()
def fit_m5(spark: SparkSession, d: str) -> DataFrame:
    return _gamma_fits(spark, d)


@query()
def laplace_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Covariances of the log parameters of both session models, from sums at the shapes that the differences need."""
    step = 0.02
    sessions = _sessions(spark, d)
    near = F.transform(F.sequence(F.lit(0), F.lit(LADDER - 1)), lambda i: F.col("p") * F.exp((F.least(i, F.lit(2)) - 1) * step))
    m4 = _at_shapes(_waits(spark, d), sessions, _weibull_fits(spark, d).select("campaign", "p", "q", near.alias("shapes")))

    def curve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                z, steps = np.log([row.p, max(row.q, 1e-300)]), np.full(2, step)
                if row.family == "M4":
                    held = [_sums(row, i) for i in range(3)]
                    cost = lambda x, held=held, z=z: -held[1 + round((x[0] - z[0]) / step)].ll(math.exp(x[0]), math.exp(x[1]))
                else:
                    n, w = np.asarray(row.n), np.asarray(row.b) - np.asarray(row.a)
                    cost = lambda x, n=n, w=w: -renewal.gamma_counts_ll(math.exp(x[0]), math.exp(x[1]), n, w)
                out.append((row.campaign, row.family, special.laplace_covariance(special.hessian(cost, z, steps), steps).ravel()))
            yield pd.DataFrame(out, columns=["campaign", "family", "cov"])

    columns = ["campaign", "family", "p", "q", "a", "b", "n", "gaps", "log_gaps", "powers"]
    m5 = sessions.join(_gamma_fits(spark, d).drop("ll"), "campaign").withColumns({"gaps": F.lit(None).cast("bigint"), "log_gaps": F.lit(None).cast("double"), "powers": F.lit(None).cast("array<double>")})
    return m4.withColumn("family", F.lit("M4")).select(columns).unionByName(m5.select(columns)).mapInPandas(curve, "campaign string, family string, cov array<double>")


CHUNK = 16
_KERNEL_PERIODS = [0.5 + 0.01 * i for i in range(128)]
_KERNEL_SCAN = {"sigmas": (1 / 24, 2 / 24), "taus": np.asarray([1.5 / 24, 3 / 24])}
EVENTS_AT_ONCE = 100_000


def kernel_winners(events: DataFrame, sessions: DataFrame, periods: list[float], **scan) -> DataFrame:
    """Each campaign's best cell of both visit models: events (campaign, t in days) and sessions (campaign, a, b, n).

    A campaign's events are dealt to blocks of about `EVENTS_AT_ONCE`; each block is
    counted once into the cells of the lattice, the counts are summed by cell, and each
    chunk of periods is judged once from the sums and the sessions.  The winner is the
    first of the greatest, in scan order.
    """
    chunks = [periods[s : s + CHUNK] for s in range(0, len(periods), CHUNK)]

    def count(block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["campaign", "model", "chunk", "cell", "n"])]
        for model in ("M2", "M3"):
            for i, own in enumerate(chunks):
                n = kernel.cell_counts(block["t"].to_numpy(), own, model == "M3", **scan)
                some = np.flatnonzero(n)
                out.append(pd.DataFrame({"campaign": block["campaign"].iloc[0], "model": model, "chunk": i, "cell": some, "n": n[some]}))
        return pd.concat(out[1:])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                own, a, b = chunks[row.chunk], np.asarray(row.a), np.asarray(row.b)
                counts = kernel.cell_counts(np.zeros(0), own, row.model == "M3", **scan)
                for x in row.cells if row.cells is not None else ():
                    counts[x["cell"]] = x["n"]
                c = kernel.best_cell(counts, int(np.sum(row.n)), a - a[0], b - a[0], own, row.model == "M3", **scan)
                out.append((row.campaign, row.model, row.chunk, c.ll, c.period, c.sigma, c.tau, c.t0))
            yield pd.DataFrame(out, columns=["campaign", "model", "chunk", "ll", "period", "sigma", "tau", "t0"])

    held = F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y)
    origin = sessions.select("campaign", F.element_at("a", 1).alias("origin"), F.greatest(F.ceil(held / EVENTS_AT_ONCE), F.lit(1)).alias("blocks"))
    placed = events.join(origin, "campaign").select("campaign", F.pmod(F.xxhash64("t"), "blocks").alias("block"), (F.col("t") - F.col("origin")).alias("t"))
    counted = placed.groupBy("campaign", "block").applyInPandas(count, "campaign string, model string, chunk int, cell bigint, n bigint").groupBy("campaign", "model", "chunk", "cell").agg(F.sum("n").alias("n"))
    cells = counted.groupBy("campaign", "model", "chunk").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # no more than the cells of a chunk
    grid = events.sparkSession.createDataFrame([(m, i) for m in ("M2", "M3") for i in range(len(chunks))], "model string, chunk int")
    rows = sessions.join(F.broadcast(grid)).join(cells, ["campaign", "model", "chunk"], "left").repartition("campaign", "model", "chunk")
    found = rows.mapInPandas(judge, "campaign string, model string, chunk int, ll double, period double, sigma double, tau double, t0 double")
    best = found.groupBy("campaign", "model").agg(F.max(F.struct("ll", (-F.col("chunk")).alias("order"), "period", "sigma", "tau", "t0")).alias("m"))
    return best.select("campaign", "model", "m.ll", "m.period", "m.sigma", "m.tau", "m.t0")


@query()
def kernel_scan(spark: SparkSession, d: str, sessions: DataFrame | None = None) -> DataFrame:
    events = frames.observed(spark, d).select("campaign", _day(F.col("t")).alias("t"))
    return kernel_winners(events, cut(_sessions(spark, d)) if sessions is None else sessions, _KERNEL_PERIODS, **_KERNEL_SCAN)


@query()
def lambda_full(spark: SparkSession, d: str) -> DataFrame:
    """The statistic with fitted session models and the kernel's scans: all six likelihoods of each campaign."""
    sessions = cut(_sessions(spark, d))
    scans = kernel_scan(spark, d, sessions).groupBy("campaign").pivot("model", ["M2", "M3"]).agg(F.first("ll"))
    rows = phases.m0_ll(spark, d).select("campaign", F.col("ll").alias("M0")).join(phases.m1_scan(spark, d).select("campaign", F.col("ll").alias("M1")), "campaign")
    for family, fits in (("M4", _weibull_fits), ("M5", _gamma_fits)):
        rows = rows.join(fits(spark, d, sessions).select("campaign", F.col("ll").alias(family)), "campaign")
    return rows.join(scans, "campaign").withColumn("lam", 2 * (F.greatest("M2", "M3") - F.greatest("M0", "M1", "M4", "M5")))
