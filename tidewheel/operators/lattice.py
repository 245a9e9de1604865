"""Period lattices: generators, visit templates, counts, exposures and scans.

A lattice row is (campaign, period_id, sigma_id, tau_id, period_us, h, n_t0, visits): visits
start at t0 = i * h for i < n_t0, and `visits` lists the (u, w) of the template.  An
event lies in few cells of a row; those are computed from its phase, so counting
costs events by lattice rows by a handful, not events by cells.

Sessions and totals grow with the data, so no join on a campaign is forced to
broadcast: Spark broadcasts a side by its measured size, and splits a hot campaign
otherwise.  Only tables made from constants carry the hint.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.likelihood import two_bin
from tidewheel.functions.timeaxis import DAY_US, quotient
from tidewheel.operators.kernel import Exposure

KEY = ["campaign", "period_id", "sigma_id", "tau_id"]


def visit_template(period: Column, sigma: Column, tau: Column) -> Column:
    """The visits of one pass or a pair of passes: a pair closer than its width is one long visit."""

    def visit(start: Column, end: Column) -> Column:
        return F.struct(start.cast("bigint").alias("u"), (end - start).cast("bigint").alias("w"))

    first = visit(F.lit(0), F.least(sigma, period))
    merged = visit(F.lit(0), F.least(tau + sigma, period))
    pair = F.array(first, visit(tau, F.least(tau + sigma, period)))
    return F.when(tau.isNull(), F.array(first)).when(tau < sigma, F.array(merged)).otherwise(pair)


def octave_grid(spans: DataFrame, least_period: float, sigma: float) -> DataFrame:
    """Octaves of periods up to a third of each campaign's `span` (days): bounds, frequency step and number of frequencies.

    An octave's frequencies run from 1 / t_hi (included) to 1 / t_lo (not) in steps
    of sigma / (2 t_hi span); the last octave is cut off at the longest period.
    """
    top = F.col("span") / 3
    octaves = F.greatest(F.ceil(F.log2(top / least_period)).cast("bigint"), F.lit(0).cast("bigint"))
    rows = spans.filter(top > least_period).withColumn("octave", F.explode(F.sequence(F.lit(0).cast("bigint"), octaves - 1)))
    rows = rows.withColumn("t_lo", F.lit(least_period) * F.pow(F.lit(2.0), F.col("octave"))).withColumn("t_hi", F.least(F.col("t_lo") * 2, top))
    rows = rows.withColumn("df", F.lit(sigma) / (2 * F.col("t_hi") * F.col("span")))
    count = F.ceil((1 / F.col("t_lo") - 1 / F.col("t_hi")) / F.col("df")).cast("bigint")
    return rows.withColumn("n_f", count)


def width_ladder(octaves: DataFrame, least_s: float) -> DataFrame:
    """Each octave with k and sigma_s: `least_s` seconds and its doublings up to half the longest period; an octave without one is left out."""
    half = F.col("t_hi") * 86400 / 2
    k = F.floor(F.log2(half / least_s) + 1e-9).cast("bigint")
    rows = octaves.filter(half >= least_s).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), k)))
    return rows.withColumn("sigma_s", F.lit(least_s) * F.pow(F.lit(2.0), F.col("k"))).filter(F.col("sigma_s") * 2 <= F.col("t_hi") * 86400)


def separations(octaves: DataFrame, least_s: float, number: int) -> DataFrame:
    """Each octave with k and tau_s: `number` separations from `least_s` seconds in steps of 1.5, as far as twice one fits the longest period; an octave without one is left out."""
    rows = octaves.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint"))))
    return rows.withColumn("tau_s", F.lit(least_s) * F.pow(F.lit(1.5), F.col("k"))).filter(F.col("tau_s") * 2 <= F.col("t_hi") * 86400)


def periods(octaves: DataFrame) -> DataFrame:
    """One row for each period of `octaves`, shorter ones last in an octave; made where they are used, never stored."""
    rows = octaves.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_f") - 1)))
    return rows.withColumn("f", 1 / F.col("t_hi") + F.col("i") * F.col("df")).withColumn("period", 1 / F.col("f"))


def even_chunks(octaves: DataFrame, most: int) -> DataFrame:
    """Splits each octave's indices into ceil(n_f / most) runs whose lengths differ by one at most, the longer ones first."""
    k = F.ceil(F.col("n_f") / most).cast("bigint")
    rows = octaves.withColumn("k", k).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    size, longer = quotient(F.col("n_f"), F.col("k")), F.pmod("n_f", "k")
    start = F.col("chunk") * size + F.least(F.col("chunk"), longer)
    return rows.withColumn("first", start).withColumn("size", size + F.when(F.col("chunk") < longer, 1).otherwise(0))


def lattice(spark: SparkSession, campaigns: DataFrame, periods_us: Sequence[int], sigmas_us: Sequence[int], taus_us: Sequence[int] = ()) -> DataFrame:
    """The lattice rows of each campaign: sigma up to half the period, tau (for pairs) up to half the period."""
    t = spark.createDataFrame(list(enumerate(periods_us)), "period_id bigint, period_us bigint")
    s = spark.createDataFrame(list(enumerate(sigmas_us)), "sigma_id bigint, sigma bigint")
    rows = campaigns.select("campaign").join(F.broadcast(t.join(F.broadcast(s), F.col("sigma") * 2 <= F.col("period_us"))))
    if taus_us:
        d = spark.createDataFrame(list(enumerate(taus_us)), "tau_id bigint, tau bigint")
        rows = rows.join(F.broadcast(d), F.col("tau") * 2 <= F.col("period_us"))
    else:
        rows = rows.withColumns({"tau_id": F.lit(-1).cast("bigint"), "tau": F.lit(None).cast("bigint")})
    h = F.col("sigma") / 2
    return rows.withColumn("h", h.cast("bigint")).withColumn("n_t0", F.ceil(F.col("period_us") / h).cast("bigint")).withColumn("visits", visit_template(F.col("period_us"), F.col("sigma"), F.col("tau")))


def cell_counts(events: DataFrame, rows: DataFrame, origin: str = "tref", by: Sequence[str] = ()) -> DataFrame:
    """n_in of each cell that holds an event, for each value of `by`: events (campaign, t, tref) against lattice rows."""
    hit = events.join(rows, "campaign").withColumn("v", F.explode("visits"))
    psi = F.pmod(F.col("t") - F.col(origin) - F.col("v.u"), F.col("period_us"))
    hit = hit.withColumn("psi", psi)
    h, w, last = F.col("h"), F.col("v.w"), F.col("n_t0") - 1

    def run(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    plain = run(F.greatest(quotient(F.col("psi") - w, h) + 1, F.lit(0).cast("bigint")), F.least(quotient(F.col("psi"), h), last))
    wrapped = run(F.greatest(quotient(F.col("psi") - w + F.col("period_us"), h) + 1, quotient(F.col("psi"), h) + 1), last)
    cells = hit.withColumn("i", F.explode(F.concat(plain, wrapped)))
    return cells.groupBy(*KEY, "i", *by).agg(F.count("*").alias("n_in"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exposed(period: pd.Series, h: pd.Series, n_t0: pd.Series, u: pd.Series, w: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Live microseconds in the visits at each t0 of a lattice row; rows of one campaign and period share the sorted edges."""
    folded: dict[tuple[int, bytes, bytes], Exposure] = {}
    out = []
    for t, step, n, us, ws, starts, ends in zip(period, h, n_t0, u, w, a, b, strict=True):
        key = t, starts.tobytes(), ends.tobytes()
        if key not in folded:
            folded[key] = Exposure(starts, ends, t)
        t0 = np.arange(n) * step
        out.append(sum(folded[key].within(np.mod(t0 + start, t), width) for start, width in zip(us, ws, strict=True)).astype(np.int64))
    return pd.Series(out)


def cell_exposures(windows: DataFrame, rows: DataFrame, origin: str = "tref") -> DataFrame:
    """Live microseconds in the visits of every cell: windows (campaign, a, b, tref) against lattice rows.

    A campaign's sessions, which the calendar bounds, are one row of sorted edges with
    prefix sums; each cell reads it by binary search, so no cell meets the sessions.
    Sums of whole microseconds stay exact.
    """
    edges = windows.groupBy("campaign").agg(F.collect_list(F.struct((F.col("a") - F.col(origin)).alias("a"), (F.col("b") - F.col(origin)).alias("b"))).alias("_edges"))
    exposed = _exposed("period_us", "h", "n_t0", F.col("visits.u"), F.col("visits.w"), F.col("_edges.a"), F.col("_edges.b"))
    return rows.join(edges, "campaign").select(*KEY, "period_us", "h", F.posexplode(exposed).alias("i", "e_us")).withColumn("i", F.col("i").cast("bigint"))


def scan(events: DataFrame, windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Log-likelihood of every cell: n_in, exposure and the profile value (rounded to 6 places) with the campaign's totals."""
    live = windows.groupBy("campaign").agg(F.sum(F.col("b") - F.col("a")).alias("live_us"), F.min("a").alias("tref"))
    n = events.groupBy("campaign").agg(F.count("*").alias("n"))
    totals = live.join(n, "campaign", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    exposed = cell_exposures(windows.join(live.select("campaign", "tref"), "campaign"), rows)
    counted = cell_counts(events.join(live.select("campaign", "tref"), "campaign"), rows)
    cells = exposed.join(counted, [*KEY, "i"], "left").join(totals, "campaign").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    day = F.lit(float(DAY_US))
    ll = two_bin(F.col("n_in"), F.col("e_us") / day, F.col("n"), F.col("live_us") / day)
    return cells.withColumn("ll", F.round(ll, 6))


def scan_streams(events: DataFrame, windows: DataFrame, rows: DataFrame, stream: str = "stream") -> DataFrame:
    """The best cell of each stream of each campaign among the cells that hold an event of it, with n_in, e_us and ll (to 6 places).

    All streams share the exposures of a cell.  At one count the likelihood falls with
    the exposure, so only the least exposure of each count has its logarithms taken;
    of equal values the one of least exposure wins, then the first in scan order.
    """
    live = windows.groupBy("campaign").agg(F.sum(F.col("b") - F.col("a")).alias("live_us"), F.min("a").alias("tref"))
    origin = live.select("campaign", "tref")
    exposed = cell_exposures(windows.join(origin, "campaign"), rows).select(*KEY, "i", "e_us")
    counted = cell_counts(events.join(origin, "campaign"), rows, by=[stream])
    order = ["period_id", "sigma_id", "tau_id", "i"]
    least = counted.join(exposed, [*KEY, "i"]).groupBy("campaign", stream, "n_in").agg(F.min(F.struct("e_us", *order)).alias("m"))
    totals = events.groupBy("campaign", stream).agg(F.count("*").alias("n")).join(live.select("campaign", "live_us"), "campaign")
    day = F.lit(float(DAY_US))
    tried = least.select("campaign", stream, "n_in", "m.*").join(totals, ["campaign", stream])
    tried = tried.withColumn("ll", F.round(two_bin(F.col("n_in"), F.col("e_us") / day, F.col("n"), F.col("live_us") / day), 6))
    return first_best(tried.select("campaign", stream, "e_us", *order, "ll", "n_in"), ["campaign", stream], ["e_us", *order])


def first_best(cells: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first cell, in scan order, of the greatest value: one map-side-combined maximum; NaN never wins."""
    rest = [c for c in cells.columns if c not in by and c not in order and c != "ll"]
    key = F.struct(F.col("ll"), *[(-F.col(c)).alias(c) for c in order], *rest)
    best = cells.filter(~F.isnan("ll")).groupBy(*by).agg(F.max(key).alias("m"))
    return best.select(*by, *[(-F.col(f"m.{c}")).alias(c) for c in order], F.col("m.ll").alias("ll"), *[F.col(f"m.{c}").alias(c) for c in rest])


def runs(flags: DataFrame, by: Sequence[str], index: str, value: str, least: float) -> DataFrame:
    """Runs of adjoining indices whose `value` is above `least`: ends, length, greatest value and the first index that has it."""
    rows = flags.filter(F.col(value) > least)
    island = F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index))
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i")))
    found = rows.withColumn("island", island).groupBy(*by, "island").agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.count("*").alias("n_points"), top.alias("m"))
    return found.select(*by, "lo", "hi", "n_points", F.col("m.v").alias("max_value"), (-F.col("m.i")).alias("at_max"))
