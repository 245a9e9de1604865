"""Schedule aliases: day-rational frequencies, the spectral window and peak flags."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.timeaxis import DAY_US, quotient
from tidewheel.operators.events import BUCKET, islands
from tidewheel.operators.lattice import even_chunks, octave_grid

# Turns of the sky and of the sun per day, the harmonics and the ratios that make an alias.
SIDEREAL, SOLAR = 1.0 / 0.99726957, 1.0
HARMONICS, RATIO = (1, 2), (1, 2, 3)
PEAK = 0.2


def day_rationals(spark: SparkSession) -> DataFrame:
    """The distinct harmonics of small ratios of the sidereal and the solar day frequency, to 9 places."""
    turn = F.explode(F.array(F.lit(SIDEREAL), F.lit(SOLAR))).alias("turn")
    rows = spark.range(1).select(turn)
    for name, values in (("n", HARMONICS), ("p", RATIO), ("q", RATIO)):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.select(F.round(F.col("n") * (F.col("p") / F.col("q")) * F.col("turn"), 9).alias("f")).distinct()


def day_rational_values() -> list[float]:
    """The same as numbers."""
    return sorted({round(n * (p / q) * turn, 9) for n in HARMONICS for p in RATIO for q in RATIO for turn in (SIDEREAL, SOLAR)})


def spectral_power(windows: DataFrame, frequencies: DataFrame, by: str = "campaign") -> DataFrame:
    """Squared modulus of the windows' transform over live time at each frequency (per day); 0 at frequency 0.

    Windows are joined whole; each pair is two sines and cosines, summed with map-side
    combination, so nothing but (campaign, frequency) sums is shuffled.
    """
    day = F.lit(float(DAY_US))
    w = 2 * math.pi * F.col("f")
    a, b = F.col("a") / day, F.col("b") / day
    divisor = F.when(F.col("f") == 0, F.lit(1.0)).otherwise(w)
    rows = frequencies.join(windows, by)
    sums = rows.groupBy(by, "i", "f").agg(F.sum((F.sin(w * b) - F.sin(w * a)) / divisor).alias("re"), F.sum((F.cos(w * a) - F.cos(w * b)) / divisor).alias("im"), F.sum(b - a).alias("live"))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("live") * F.col("live"))
    return sums.select(by, "i", "f", power.alias("power"))


def dilate(flags: DataFrame, by: str, index: str, flag: Column, cells: int) -> DataFrame:
    """Adds `near`: whether a flagged index lies within `cells` of this one."""
    return flags.withColumn("near", F.max(flag.cast("int")).over(Window.partitionBy(by).orderBy(index).rowsBetween(-cells, cells)) == 1)


def flag_peaks(peaks: DataFrame, rationals: DataFrame, intervals: DataFrame, tolerance: str = "tol", by: str = "campaign") -> DataFrame:
    """Adds `source`: day_rational within the tolerance of one, else window_peak within that of an interval, else null.

    `peaks` has f and the tolerance; both alias tables are small and are joined by
    bands without a cross product reaching the shuffle: first the 20 rationals, then
    the intervals of the peak's own campaign.
    """
    f, tol = F.col("f"), F.col(tolerance)
    near = peaks.join(F.broadcast(rationals.select(F.col("f").alias("fa"))), F.abs(f - F.col("fa")) < tol, "left_semi").select(by, "peak_id").distinct().withColumn("rational", F.lit(True))
    held = peaks.join(intervals.select(F.col(by).alias("_by"), "f_lo", "f_hi"), (F.col(by) == F.col("_by")) & (f >= F.col("f_lo") - tol) & (f <= F.col("f_hi") + tol), "left_semi").select(by, "peak_id").distinct().withColumn("held", F.lit(True))
    rows = peaks.join(near, [by, "peak_id"], "left").join(held, [by, "peak_id"], "left")
    return rows.withColumn("source", F.when(F.col("rational"), "day_rational").when(F.col("held"), "window_peak")).drop("rational", "held")


LIVE_STEPS = 4  # of the live rule's grid to a tolerance
LIVE_LEAST = 3.0  # its grid ends there, or at half as much again as the peak


def flag_live(peaks: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds `rational` and `near_peak` to peaks (campaign, peak_id, f, tol): less than tol from a day-rational, or from a grid point of the spectral window above `PEAK`.

    The grid runs from tol in steps of tol / 4 up to the greater of 3 and 1.5 f; only its
    at most 8 points that are near enough are made, so no grid is scanned.
    """
    f, tol = F.col("f"), F.col("tol")
    step = tol / LIVE_STEPS
    points = F.ceil((F.greatest(F.lit(LIVE_LEAST), 1.5 * f) - tol) / step).cast("bigint")
    first = F.greatest(F.floor((f - 2 * tol) / step).cast("bigint"), F.lit(0).cast("bigint"))
    last = F.least(F.ceil(f / step).cast("bigint"), points - 1)
    j = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    grid = peaks.select("campaign", "peak_id", "f", "tol", F.explode(j).alias("j")).withColumn("g", tol + F.col("j") * step).filter(F.abs(F.col("g") - f) < tol)
    power = spectral_power(windows, grid.select("campaign", F.struct("peak_id", "j").alias("i"), F.col("g").alias("f")))
    above = power.filter(F.round("power", 6) > PEAK).select("campaign", F.col("i.peak_id").alias("peak_id")).distinct().withColumn("near_peak", F.lit(True))
    near = F.exists(F.array(*[F.lit(x) for x in day_rational_values()]), lambda x: F.abs(f - x) < tol)
    return peaks.join(above, ["campaign", "peak_id"], "left").withColumns({"near_peak": F.coalesce("near_peak", F.lit(False)), "rational": near})


CHUNK = 4096  # frequencies that a task works on at once


def window_runs(octaves: DataFrame, windows: DataFrame, least: float = PEAK) -> DataFrame:
    """campaign, octave and the runs of grid frequencies whose spectral window is above `least`: lo, hi, n_points, max_value, at_max (indices).

    The grid is made where it is used: a row is a chunk of an octave with its
    campaign's sessions (campaign, a, b in days), which the calendar bounds, and gives
    back the runs within it.  Powers are rounded to 6 places before they are compared.
    """
    spans = windows.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("w"))
    chunks = even_chunks(octaves, CHUNK).select("campaign", "octave", "chunk", "first", "size", "t_hi", "df")
    rows = chunks.join(spans.select("campaign", F.col("w.a").alias("a"), F.col("w.b").alias("b")), "campaign").repartition("campaign", "octave", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                w = 2 * np.pi * (1 / r.t_hi + np.arange(r.first, r.first + r.size) * r.df)
                total = np.zeros(len(w), dtype=complex)
                for a, b in zip(r.a - r.a[0], r.b - r.a[0], strict=True):
                    total += np.exp(1j * w * b) - np.exp(1j * w * a)
                power = np.round(np.abs(total / w) ** 2 / np.sum(r.b - r.a) ** 2, 6)
                above = np.flatnonzero(power > least)
                parts = np.split(above, np.flatnonzero(np.diff(above) > 1) + 1) if len(above) else []
                found = [(r.campaign, r.octave, r.first + p[0], r.first + p[-1], len(p), power[p].max(), r.first + p[0] + int(np.argmax(power[p]))) for p in parts]
                yield pd.DataFrame(found, columns=["campaign", "octave", "lo", "hi", "n_points", "max_value", "at_max"])

    return _joined(rows.mapInPandas(run, "campaign string, octave bigint, lo bigint, hi bigint, n_points bigint, max_value double, at_max bigint"))


def _joined(runs: DataFrame) -> DataFrame:
    """Runs that touch across the borders of chunks as one."""
    keys = ["campaign", "octave"]
    top = F.max(F.struct("max_value", (-F.col("at_max")).alias("at"))).alias("m")
    found = islands(runs.withColumn(BUCKET, quotient(F.col("lo"), F.lit(CHUNK))), keys).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_points").alias("n_points"), top)
    return found.select(*keys, "lo", "hi", "n_points", F.col("m.max_value").alias("max_value"), (-F.col("m.at")).alias("at_max"))


def _rational_cells(octaves: DataFrame, tolerance: Column) -> DataFrame:
    """campaign, octave, lo, hi: the grid indices less than the tolerance away from each day-rational frequency."""
    x, f0, df = F.col("x"), 1 / F.col("t_hi"), F.col("df")
    rows = octaves.join(F.broadcast(day_rationals(octaves.sparkSession).withColumnRenamed("f", "x")))

    def near(at: Column, first: int, last: int) -> Column:
        at = at.cast("bigint")
        return F.filter(F.sequence(at + first, at + last), lambda i: F.abs(f0 + i * df - x) < tolerance)

    low, high = F.array_min(near(F.floor((x - tolerance - f0) / df), -1, 2)), F.array_max(near(F.ceil((x + tolerance - f0) / df), -2, 1))
    return rows.select("campaign", "octave", F.greatest(low, F.lit(0).cast("bigint")).alias("lo"), F.least(high, F.col("n_f") - 1).alias("hi")).filter("lo <= hi")


def alias_octaves(octaves: DataFrame, runs: DataFrame) -> DataFrame:
    """campaign, octave, t_lo, t_hi, df, n_f, n_peak_points and n_flagged of the grid.

    A frequency is flagged within 2 / span of a day-rational, or within as many cells
    of a run as that tolerance has (rounded up, cut off at the octave's ends).  The
    flagged set is the union of intervals of indices, so no frequency is listed.
    """
    tolerance = 2 / F.col("span")
    cells = F.ceil(tolerance / F.col("df")).cast("bigint")
    wide = runs.join(octaves.select("campaign", "octave", cells.alias("k"), "n_f"), ["campaign", "octave"])
    wide = wide.select("campaign", "octave", F.greatest(F.col("lo") - F.col("k"), F.lit(0).cast("bigint")).alias("lo"), F.least(F.col("hi") + F.col("k"), F.col("n_f") - 1).alias("hi"))
    both = wide.unionByName(_rational_cells(octaves, tolerance)).withColumn(BUCKET, quotient(F.col("lo"), F.lit(CHUNK)))
    whole = islands(both, ["campaign", "octave"]).groupBy("campaign", "octave", "island").agg((F.max("hi") - F.min("lo") + 1).alias("n"))
    flagged = whole.groupBy("campaign", "octave").agg(F.sum("n").alias("n_flagged"))
    points = runs.groupBy("campaign", "octave").agg(F.sum("n_points").alias("n_peak_points"))
    rows = octaves.join(flagged, ["campaign", "octave"], "left").join(points, ["campaign", "octave"], "left")
    return rows.select("campaign", "octave", "t_lo", "t_hi", "df", "n_f", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_peak_points", "n_flagged")])


def alias_summary(windows: DataFrame, octaves: DataFrame, counted: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a campaign: sessions, span and live days, the longest period, the tolerance, grid points, peak intervals and the flagged share."""
    sessions = windows.groupBy("campaign").agg(F.count("*").alias("n_sessions"), F.sum(F.col("b") - F.col("a")).alias("live_days"))
    spans = octaves.groupBy("campaign").agg(F.max("span").alias("span_days"))
    grid = counted.groupBy("campaign").agg(F.sum("n_f").alias("n_f_total"), F.sum("n_flagged").alias("n_flagged"))
    peaks = runs.groupBy("campaign").agg(F.count("*").alias("n_peak_intervals"))
    rows = sessions.join(spans, "campaign").join(grid, "campaign").join(peaks, "campaign", "left")
    return rows.select("campaign", "n_sessions", "span_days", "live_days", (F.col("span_days") / 3).alias("p_max_days"), (2 / F.col("span_days")).alias("tolerance"), "n_f_total", F.coalesce("n_peak_intervals", F.lit(0)).alias("n_peak_intervals"), (F.col("n_flagged") / F.col("n_f_total")).alias("flagged_frac"))


def write_alias_set(windows: DataFrame, path: str, least_period: float = 1 / 24, sigma: float = 60 / 86400) -> DataFrame:
    """Builds the alias set of `windows` (campaign, a, b in days) and writes it as JSON: `peaks` and `octaves` by campaign, and `summary`, which it returns as read back.

    Each part is replaced for the campaigns it has, so a rerun gives the same and other
    campaigns stay.
    """
    spark = windows.sparkSession
    spans = windows.groupBy("campaign").agg((F.max_by("b", "a") - F.min("a")).alias("span"))
    octaves = octave_grid(spans, least_period, sigma)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("campaign").json(f"{path}/{name}")
        return spark.read.schema(rows.schema).json(f"{path}/{name}")

    f = [(1 / F.col("t_hi") + F.col(i) * F.col("df")).alias(name) for i, name in (("lo", "f_lo"), ("hi", "f_hi"), ("at_max", "f_at_max"))]
    runs = written(window_runs(octaves, windows).join(octaves.select("campaign", "octave", "t_hi", "df"), ["campaign", "octave"]).select("campaign", "octave", "lo", "hi", "n_points", "max_value", "at_max", *f), "peaks")
    counted = written(alias_octaves(octaves, runs), "octaves")
    return written(alias_summary(windows, octaves, counted, runs), "summary")
