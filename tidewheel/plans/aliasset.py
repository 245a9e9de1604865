"""Queries of the alias set: peaks of the spectral window on the period grid, flagged frequencies, and the summary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.timeaxis import DAY_US
from tidewheel.operators import alias
from tidewheel.operators.lattice import octave_grid
from tidewheel.plans import frames
from tidewheel.plans.frames import WINDOWS_SQL

Q: dict = {}
SQL: dict[str, str] = {}

LEAST_PERIOD, SIGMA = 1 / 24, 600 / 86400  # ten minutes keep the SQL's list of frequencies short
_PI2 = f"{2 * math.pi!r}::DOUBLE"


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions in days, octaves and runs."""
    day = F.lit(float(DAY_US))
    windows = frames.windows(spark, d).select("campaign", (F.col("a") / day).alias("a"), (F.col("b") / day).alias("b"))
    spans = frames.windows(spark, d).groupBy("campaign").agg(((F.max_by("b", "a") - F.min("a")) / day).alias("span"))
    octaves = octave_grid(spans, LEAST_PERIOD, SIGMA)
    return windows, octaves, alias.window_runs(octaves, windows)


_SETUP = f"""{WINDOWS_SQL}, wd AS (SELECT campaign, a / 8.64e10::DOUBLE AS a, b / 8.64e10::DOUBLE AS b FROM win),
sp AS (SELECT campaign, (arg_max(b, a) - min(a)) / 8.64e10::DOUBLE AS span FROM win GROUP BY 1),
o0 AS (SELECT campaign, span, unnest(range(0, CAST(greatest(ceil(log2(span / 3 / {LEAST_PERIOD!r}::DOUBLE)), 0) AS BIGINT))) AS octave FROM sp),
o1 AS (SELECT *, {LEAST_PERIOD!r}::DOUBLE * power(2.0::DOUBLE, octave) AS t_lo, least({LEAST_PERIOD!r}::DOUBLE * power(2.0::DOUBLE, octave) * 2, span / 3) AS t_hi FROM o0),
o2 AS (SELECT *, {SIGMA!r}::DOUBLE / (2 * t_hi * span) AS df FROM o1),
oc AS (SELECT *, CAST(ceil((1 / t_lo - 1 / t_hi) / df) AS BIGINT) AS n_f FROM o2),
gr AS (SELECT *, 1 / t_hi + i * df AS f FROM (SELECT campaign, octave, span, t_hi, df, unnest(range(0, n_f)) AS i FROM oc)),
pw AS (SELECT gr.campaign, octave, i, any_value(f) AS f, any_value(span) AS span, any_value(df) AS df,
    round((pow(sum((sin({_PI2} * f * b) - sin({_PI2} * f * a)) / ({_PI2} * f)), 2) + pow(sum((cos({_PI2} * f * a) - cos({_PI2} * f * b)) / ({_PI2} * f)), 2)) / pow(sum(b - a), 2), 6) AS power FROM gr JOIN wd ON wd.campaign = gr.campaign GROUP BY gr.campaign, octave, i),
rs AS (SELECT *, i - row_number() OVER (PARTITION BY campaign, octave ORDER BY i) AS island FROM pw WHERE power > 0.2),
rn AS (SELECT campaign, octave, min(i) AS lo, max(i) AS hi, count(*) AS n_points, max(power) AS max_value, min(CASE WHEN power = m THEN i END) AS at_max FROM (SELECT *, max(power) OVER (PARTITION BY campaign, octave, island) AS m FROM rs) GROUP BY campaign, octave, island),
ra AS (SELECT DISTINCT round(n * (p / q) * turn, 9) AS x FROM (SELECT unnest([1, 2]) AS n), (SELECT unnest([1.0::DOUBLE, 2, 3]) AS p), (SELECT unnest([1.0::DOUBLE, 2, 3]) AS q), (SELECT unnest([1.0::DOUBLE / 0.99726957::DOUBLE, 1.0]) AS turn)),
fl AS (SELECT *, power > 0.2 AS peak, EXISTS (SELECT 1 FROM ra WHERE abs(pw.f - x) < 2 / span) OR EXISTS (SELECT 1 FROM rn WHERE rn.campaign = pw.campaign AND rn.octave = pw.octave AND pw.i BETWEEN lo - ceil(2 / span / df) AND hi + ceil(2 / span / df)) AS flagged FROM pw),
al AS (SELECT campaign, octave, count(*) AS n_f, count(*) FILTER (peak) AS n_peak_points, count(*) FILTER (flagged) AS n_flagged FROM fl GROUP BY ALL)"""


@query(f"WITH {_SETUP} SELECT rn.*, round(f, 9) AS f_at_max FROM rn JOIN pw ON pw.campaign = rn.campaign AND pw.octave = rn.octave AND pw.i = at_max")
def alias_set_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of grid frequencies above the threshold, whole across the borders of the chunks they are found in."""
    _, octaves, runs = _parts(spark, d)
    rows = runs.join(octaves.select("campaign", "octave", "t_hi", "df"), ["campaign", "octave"])
    return rows.select(*runs.columns, F.round(1 / F.col("t_hi") + F.col("at_max") * F.col("df"), 9).alias("f_at_max"))


@query(f"WITH {_SETUP} SELECT *, round(n_flagged / n_f::DOUBLE, 9) AS flagged_frac FROM al")
def alias_set_octaves(spark: SparkSession, d: str) -> DataFrame:
    """Grid size, peak points and flagged frequencies of each octave."""
    _, octaves, runs = _parts(spark, d)
    rows = alias.alias_octaves(octaves, runs).select("campaign", "octave", "n_f", "n_peak_points", "n_flagged")
    return rows.withColumn("flagged_frac", F.round(F.col("n_flagged") / F.col("n_f"), 9))


@query(
    f"WITH {_SETUP} SELECT sp.campaign, (SELECT count(*) FROM wd WHERE wd.campaign = sp.campaign) AS n_sessions, round(span, 6) AS span_days, round((SELECT sum(b - a) FROM wd WHERE wd.campaign = sp.campaign), 6) AS live_days, round(span / 3, 6) AS p_max_days, round(2 / span, 9) AS tolerance, "
    "(SELECT sum(n_f)::BIGINT FROM al WHERE al.campaign = sp.campaign) AS n_f_total, (SELECT count(*) FROM rn WHERE rn.campaign = sp.campaign) AS n_peak_intervals, round((SELECT sum(n_flagged) / sum(n_f)::DOUBLE FROM al WHERE al.campaign = sp.campaign), 9) AS flagged_frac FROM sp"
)
def alias_set_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row a campaign of its alias set."""
    windows, octaves, runs = _parts(spark, d)
    rows = alias.alias_summary(windows, octaves, alias.alias_octaves(octaves, runs), runs)
    rounded = {c: F.round(c, 9 if c in ("tolerance", "flagged_frac") else 6) for c in ("span_days", "live_days", "p_max_days", "tolerance", "flagged_frac")}
    return rows.withColumns(rounded)


_CANDIDATES = 16
_LIVE_SQL = f"""{WINDOWS_SQL}, wd AS (SELECT campaign, a / 8.64e10::DOUBLE AS a, b / 8.64e10::DOUBLE AS b FROM win),
pk AS (SELECT campaign, k AS peak_id, 0.15::DOUBLE + k * 0.37::DOUBLE AS f, 2 / ((arg_max(b, a) - min(a)) / 8.64e10::DOUBLE) AS tol FROM win, (SELECT unnest(range(0, {_CANDIDATES}))::BIGINT AS k) GROUP BY campaign, k),
gp AS (SELECT * FROM (SELECT campaign, peak_id, f, tol, tol + j * (tol / 4) AS g FROM (SELECT *, unnest(range(0, CAST(ceil((greatest(3.0::DOUBLE, 1.5::DOUBLE * f) - tol) / (tol / 4)) AS BIGINT))) AS j FROM pk)) WHERE abs(g - f) < tol),
pw AS (SELECT gp.campaign, peak_id, g, round((pow(sum((sin({_PI2} * g * b) - sin({_PI2} * g * a)) / ({_PI2} * g)), 2) + pow(sum((cos({_PI2} * g * a) - cos({_PI2} * g * b)) / ({_PI2} * g)), 2)) / pow(sum(b - a), 2), 6) AS power FROM gp JOIN wd ON wd.campaign = gp.campaign GROUP BY ALL),
ra AS (SELECT DISTINCT round(n * (p / q) * turn, 9) AS x FROM (SELECT unnest([1, 2]) AS n), (SELECT unnest([1.0::DOUBLE, 2, 3]) AS p), (SELECT unnest([1.0::DOUBLE, 2, 3]) AS q), (SELECT unnest([1.0::DOUBLE / 0.99726957::DOUBLE, 1.0]) AS turn))"""


@query(f"WITH {_LIVE_SQL} SELECT campaign, peak_id, EXISTS (SELECT 1 FROM ra WHERE abs(pk.f - x) < tol) AS rational, EXISTS (SELECT 1 FROM pw WHERE pw.campaign = pk.campaign AND pw.peak_id = pk.peak_id AND power > 0.2) AS near_peak FROM pk")
def alias_flag_grid(spark: SparkSession, d: str) -> DataFrame:
    """The live rule on each campaign's own grid: candidates less than 2 / span from a day-rational, or from a grid point above the threshold."""
    spans = frames.windows(spark, d).groupBy("campaign").agg((2 / ((F.max_by("b", "a") - F.min("a")) / F.lit(float(DAY_US)))).alias("tol"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_CANDIDATES - 1).cast("bigint")))
    peaks = spans.withColumn("peak_id", k).withColumn("f", F.lit(0.15) + F.col("peak_id") * 0.37)
    return alias.flag_live(peaks, frames.windows(spark, d)).select("campaign", "peak_id", "rational", "near_peak")
