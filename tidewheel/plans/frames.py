"""The engine's core tables over the driver's `events`, and the same in SQL.

Campaigns are event types; sessions are made by a rule, one a day for 30 days, so
that both engines see the same windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.timeaxis import DAY_US, micros
from tidewheel.operators.events import assign

HOUR_US = 3_600_000_000
DAYS = 30


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def timed(rows: DataFrame) -> DataFrame:
    """Rows of the events table as campaign, station, event_id, user_id, t and w."""
    return rows.select(F.col("event_type").alias("campaign"), (F.col("user_id") % 3).alias("station"), "event_id", "user_id", micros(F.col("ts")).alias("t"), F.col("value").alias("w"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("campaign")).distinct()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(campaigns(spark, sf_dir))


def sessions(campaigns: DataFrame) -> DataFrame:
    """The sessions of the given campaigns by the rule: campaign, session (its day), a, b; each ends on the day it begins."""
    rows = campaigns.withColumn("off", (F.ascii("campaign") + F.length("campaign")) % 16)
    days = rows.withColumn("session", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DAYS - 1).cast("bigint"))))
    start = F.col("session") * DAY_US + F.col("off").cast("bigint") * HOUR_US
    length = (4 + (F.col("session") * 7 + F.col("off")) % 5) * HOUR_US
    return days.select("campaign", "session", start.alias("a"), (start + length).cast("bigint").alias("b"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside a session, with it."""
    return assign(events(spark, sf_dir), windows(spark, sf_dir))


EVENTS_SQL = "ev AS (SELECT event_type AS campaign, user_id % 3 AS station, event_id, user_id, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) AS t, value AS w FROM events)"
CAMPAIGNS_SQL = "cp AS (SELECT DISTINCT event_type AS campaign, (ascii(event_type) + length(event_type)) % 16 AS off FROM events)"
WINDOWS_SQL = f"{CAMPAIGNS_SQL}, win AS (SELECT campaign, d AS session, CAST(d * 86400000000 + off * 3600000000 AS BIGINT) AS a, CAST(d * 86400000000 + off * 3600000000 + (4 + (d * 7 + off) % 5) * 3600000000 AS BIGINT) AS b FROM cp, (SELECT unnest(range(0, 30))::BIGINT AS d))"
OBSERVED_SQL = f"{EVENTS_SQL}, {WINDOWS_SQL}, ob AS (SELECT ev.*, win.session, win.a, win.b FROM ev JOIN win ON ev.campaign = win.campaign AND ev.t >= win.a AND ev.t < win.b)"


def floor_div(x: str, period: str) -> str:
    """Floor division in SQL, exact because the numerator is a multiple."""
    return f"(({x}) - {pos_mod(x, period)}) // ({period})"


def pos_mod(x: str, period: str) -> str:
    return f"(((({x}) % ({period})) + ({period})) % ({period}))"


def live_before(x: str, period: str, u: str, w: str) -> str:
    return f"({floor_div(x, period)} * ({w}) + least(greatest({pos_mod(x, period)} - ({u}), 0), ({w})))"


def nlogn(n: str, e: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE {n} * ln({n} / greatest({e}, 1e-12)) - {n} END"


def two_bin(n_in: str, e_in: str, n: str, live: str) -> str:
    return f"CASE WHEN {n_in} / greatest({e_in}, 1e-12) < ({n} - {n_in}) / greatest({live} - {e_in}, 1e-12) OR {e_in} <= 0 THEN {nlogn(n, live)} ELSE ({nlogn(n_in, f'greatest({e_in}, 1e-12)')}) + ({nlogn(f'({n} - {n_in})', f'greatest({live} - {e_in}, 1e-12)')}) END"
