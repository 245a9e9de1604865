"""Time axes and phase arithmetic as columns.

Times are integer microseconds, so folds, exposures and counts are exact and do not
depend on the order of summation; they become days only in the last step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC
DAY_US = 86_400_000_000
MJD_UNIX_EPOCH = 40_587


def micros(ts: Column) -> Column:
    """Microseconds since the axis' epoch of a UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp")) - F.lit(EPOCH_US)


def mjd(ts: Column) -> Column:
    """Modified Julian date of a UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(float(DAY_US)) + MJD_UNIX_EPOCH


def mjd_from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return mjd(F.make_timestamp(year, month, day, hour, minute, second))


def sexagesimal_degrees(text: Column, hours: bool) -> Column:
    """Degrees of `[-]aa:mm:ss.s`; `hours` multiplies by 15; the sign is that of the text, so -00:30:00 is negative."""
    parts = F.split(F.ltrim(F.regexp_replace(text, "[+-]", "")), ":")
    size = parts[0].cast("double") + parts[1].cast("double") / 60 + parts[2].cast("double") / 3600
    return F.when(F.ltrim(text).startswith("-"), -size).otherwise(size) * (15 if hours else 1)


def quotient(x: Column, period: Column) -> Column:
    """Floor division for a positive period."""
    return F.call_function("div", x - F.pmod(x, period), period)


def phase(t: Column, origin: Column, period: Column) -> Column:
    """(t - origin) mod period, within [0, period) also before the origin."""
    return F.pmod(t - origin, period)


def live_before(x: Column, period: Column, offset: Column, width: Column) -> Column:
    """Measure of [0, x) that lies in the visits [offset, offset + width) of each period; differences of it are exposures."""
    return quotient(x, period) * width + F.least(F.greatest(F.pmod(x, period) - offset, F.lit(0)), width)
