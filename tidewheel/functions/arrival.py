"""Arrival times at the solar system's barycentre as columns; the constants and the accuracy are those of `astronomy`.

Leap seconds are a step table that a time is looked up in as of its day, so campaigns
before the last step come out right too, and Kepler's equation is a fold of Newton
steps over a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.astronomy import AU_SECONDS, ELEMENTS, LIGHT, OBLIQUITY, SITES_GEODETIC, SITES_XYZ, SUN_OVER, site_xyz

# The days (MJD) from which TAI is one second more ahead of UTC, from 10 s in 1972 on; TT is ahead of TAI by a constant.
LEAP_DAYS = (41317, 41499, 41683, 42048, 42413, 42778, 43144, 43509, 43874, 44239, 44786, 45151, 45516, 46247, 47161, 47892, 48257, 48804, 49169, 49534, 50083, 50630, 51179, 53736, 54832, 56109, 57204, 57754)
FIRST_LEAP = 10
TT_MINUS_TAI = 32.184
J2000 = 51544.5
NEWTON_STEPS = 6
MOON_OFFSET = 4670e3  # metres of the Earth from the centre of Earth and Moon

Vector = tuple[Column, Column, Column]


def leap_seconds(mjd: Column) -> Column:
    """TAI - UTC at a UTC day; null before the first step."""
    passed = F.size(F.filter(F.array(*map(F.lit, LEAP_DAYS)), lambda day: day <= mjd))
    return F.when(passed > 0, passed + (FIRST_LEAP - 1))


def eccentric_anomaly(mean: Column, e: Column) -> Column:
    """The solution E of E - e sin E = mean, for small e."""
    steps = F.array_repeat(F.lit(0), NEWTON_STEPS)
    return F.aggregate(steps, mean + e * F.sin(mean), lambda x, _: x - (x - e * F.sin(x) - mean) / (1 - e * F.cos(x)))


def _turned(x: Column, y: Column, z: Column) -> Vector:
    """Ecliptic coordinates as equatorial ones."""
    return x, y * math.cos(OBLIQUITY) - z * math.sin(OBLIQUITY), y * math.sin(OBLIQUITY) + z * math.cos(OBLIQUITY)


def sites(spark: SparkSession) -> DataFrame:
    """site, x, y, z (geocentric, metres) of all known sites: a table made from constants."""
    names = [*SITES_XYZ, *(s for s in SITES_GEODETIC if s not in SITES_XYZ)]
    return spark.createDataFrame([(s, *site_xyz(s)) for s in names], "site string, x double, y double, z double")


def _body(rows: DataFrame, name: str) -> DataFrame:
    """Adds _<name>: the heliocentric equatorial position (au) at the century _c."""
    parts = [F.lit(p) + F.lit(r) * F.col("_c") for p, r in zip(*ELEMENTS[name], strict=True)]
    rows = rows.withColumns({"_a": parts[0], "_e": parts[1], "_i": F.radians(parts[2]), "_p": F.radians(parts[4]), "_n": F.radians(parts[5]), "_l": F.radians(parts[3])})
    turn = F.col("_l") - F.col("_p") + math.pi
    rows = rows.withColumn("_m", turn - 2 * math.pi * F.floor(turn / (2 * math.pi)) - math.pi)
    rows = rows.withColumn("_x", eccentric_anomaly(F.col("_m"), F.col("_e")))
    e, w, n, i = F.col("_e"), F.col("_p") - F.col("_n"), F.col("_n"), F.col("_i")
    rows = rows.withColumns({"_u": F.col("_a") * (F.cos("_x") - e), "_v": F.col("_a") * F.sqrt(1 - e * e) * F.sin("_x")})
    u, v = F.col("_u"), F.col("_v")
    x = (F.cos(w) * F.cos(n) - F.sin(w) * F.sin(n) * F.cos(i)) * u + (-F.sin(w) * F.cos(n) - F.cos(w) * F.sin(n) * F.cos(i)) * v
    y = (F.cos(w) * F.sin(n) + F.sin(w) * F.cos(n) * F.cos(i)) * u + (-F.sin(w) * F.sin(n) + F.cos(w) * F.cos(n) * F.cos(i)) * v
    z = F.sin(w) * F.sin(i) * u + F.cos(w) * F.sin(i) * v
    return rows.withColumn(f"_{name}", F.array(*_turned(x, y, z)))


def with_arrival(times: DataFrame) -> DataFrame:
    """Adds `offset_s`, the seconds from the topocentric UTC to the barycentric TDB at infinite frequency, and `bjd` = utc + offset.

    `times` has utc (MJD), x, y, z (the site, metres), ra and dec (degrees).  Times
    before 1972 have none.
    """
    kept = times.columns
    rows = times.withColumn("_ahead", F.lit(TT_MINUS_TAI) + leap_seconds(F.col("utc"))).withColumn("_tt", F.col("utc") + F.col("_ahead") / 86400)
    rows = rows.withColumns({"_c": (F.col("_tt") - J2000) / 36525, "_d": F.col("_tt") - J2000})
    for name in ELEMENTS:
        rows = _body(rows, name)
    d = F.col("_d")
    lon = F.radians(218.316 + 13.176396 * d) + math.radians(6.289) * F.sin(F.radians(134.963 + 13.064993 * d))
    lat = math.radians(5.128) * F.sin(F.radians(93.272 + 13.229350 * d))
    turn = F.radians(280.46061837 + 360.98564736629 * (F.col("utc") - J2000))
    rows = rows.withColumns({"_lon": lon, "_lat": lat, "_turn": turn, "_ra": F.radians("ra"), "_dec": F.radians("dec")})
    moon = _turned(F.cos("_lat") * F.cos("_lon"), F.cos("_lat") * F.sin("_lon"), F.sin("_lat"))
    place = (F.col("x") * F.cos("_turn") - F.col("y") * F.sin("_turn"), F.col("x") * F.sin("_turn") + F.col("y") * F.cos("_turn"), F.col("z"))
    towards = (F.cos("_dec") * F.cos("_ra"), F.cos("_dec") * F.sin("_ra"), F.sin("_dec"))
    delay = F.lit(0.0)
    for k in range(3):
        at = F.col("_earth")[k]
        for name, ratio in SUN_OVER.items():
            at = at - F.col(f"_{name}")[k] / (1 + ratio)
        delay = delay + towards[k] * (at * AU_SECONDS - moon[k] * (MOON_OFFSET / LIGHT) + place[k] / LIGHT)
    mean = F.radians(357.53 + 0.98560028 * d)
    offset = F.col("_ahead") + delay + 0.001657 * F.sin(mean) + 0.000022 * F.sin(2 * mean)
    return rows.withColumn("offset_s", offset).select(*kept, "offset_s", (F.col("utc") + F.col("offset_s") / 86400).alias("bjd"))


def arrival_sql(times: str) -> str:
    """Common table expressions in SQL that end in `arrived`: the columns of the table `times` with offset_s."""
    bodies, chain = [], []
    for name, (start, rate) in ELEMENTS.items():
        a, e, i, mean, peri, node = (f"({p!r}::DOUBLE + {r!r}::DOUBLE * c)" for p, r in zip(start, rate, strict=True))
        pi2 = f"{2 * math.pi!r}::DOUBLE"
        chain.append(f"{name}1 AS (SELECT *, {a} AS a, {e} AS e, radians({i}) AS i, radians({peri}) AS p, radians({node}) AS n, radians({mean}) - radians({peri}) + pi() AS turn FROM {chain and bodies[-1] or 'clock'})")
        chain.append(f"{name}2 AS (SELECT * EXCLUDE (turn), turn - {pi2} * floor(turn / {pi2}) - pi() AS m, p - n AS w FROM {name}1)")
        chain.append(f"{name}3 AS (SELECT *, list_reduce(list_prepend(m + e * sin(m), [{', '.join(['0.0'] * NEWTON_STEPS)}]::DOUBLE[]), lambda g, z: g - (g - e * sin(g) - m) / (1 - e * cos(g))) AS k FROM {name}2)")
        chain.append(f"{name}4 AS (SELECT *, a * (cos(k) - e) AS u, a * sqrt(1 - e * e) * sin(k) AS v FROM {name}3)")
        chain.append(
            f"{name}5 AS (SELECT *, (cos(w) * cos(n) - sin(w) * sin(n) * cos(i)) * u + (-sin(w) * cos(n) - cos(w) * sin(n) * cos(i)) * v AS {name}_x, "
            f"(cos(w) * sin(n) + sin(w) * cos(n) * cos(i)) * u + (-sin(w) * sin(n) + cos(w) * cos(n) * cos(i)) * v AS ey, sin(w) * sin(i) * u + cos(w) * sin(i) * v AS ez FROM {name}4)"
        )
        chain.append(f"{name}6 AS (SELECT * EXCLUDE (a, e, i, p, n, m, w, k, u, v, ey, ez), ey * cos({OBLIQUITY!r}) - ez * sin({OBLIQUITY!r}) AS {name}_y, ey * sin({OBLIQUITY!r}) + ez * cos({OBLIQUITY!r}) AS {name}_z FROM {name}5)")
        bodies.append(f"{name}6")
    earth = {k: " - ".join([f"earth_{k}", *[f"{b}_{k} / {1 + r!r}::DOUBLE" for b, r in SUN_OVER.items()]]) for k in "xyz"}
    leap = " + ".join(f"(utc >= {day})::INT" for day in LEAP_DAYS)
    return (
        f"clock AS (SELECT *, utc + ahead / 86400 AS tt, (utc + ahead / 86400 - {J2000}) / 36525 AS c FROM (SELECT *, {TT_MINUS_TAI}::DOUBLE + {FIRST_LEAP - 1} + {leap} AS ahead FROM {times})), {', '.join(chain)}, "
        f"moon AS (SELECT *, radians(218.316 + 13.176396::DOUBLE * (tt - {J2000})) + radians(6.289) * sin(radians(134.963 + 13.064993::DOUBLE * (tt - {J2000}))) AS lon, radians(5.128) * sin(radians(93.272 + 13.229350::DOUBLE * (tt - {J2000}))) AS lat, "
        f"radians(280.46061837::DOUBLE + 360.98564736629::DOUBLE * (utc - {J2000})) AS g, radians(357.53 + 0.98560028::DOUBLE * (tt - {J2000})) AS mean FROM {bodies[-1]}), "
        f"arrived AS (SELECT *, ahead + cos(radians(dec)) * cos(radians(ra)) * (({earth['x']}) * {AU_SECONDS!r} - cos(lat) * cos(lon) * {MOON_OFFSET / LIGHT!r} + (x * cos(g) - y * sin(g)) / {LIGHT!r}) "
        f"+ cos(radians(dec)) * sin(radians(ra)) * (({earth['y']}) * {AU_SECONDS!r} - (cos(lat) * sin(lon) * cos({OBLIQUITY!r}) - sin(lat) * sin({OBLIQUITY!r})) * {MOON_OFFSET / LIGHT!r} + (x * sin(g) + y * cos(g)) / {LIGHT!r}) "
        f"+ sin(radians(dec)) * (({earth['z']}) * {AU_SECONDS!r} - (cos(lat) * sin(lon) * sin({OBLIQUITY!r}) + sin(lat) * cos({OBLIQUITY!r})) * {MOON_OFFSET / LIGHT!r} + z / {LIGHT!r}) + 0.001657 * sin(mean) + 0.000022 * sin(2 * mean) AS offset_s FROM moon)"
    )
