"""Queries that report on studies and audit their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import events as ops
from tidewheel.operators.quantiles import exact_percentiles
from tidewheel.plans import frames

Q: dict = {}
SQL: dict[str, str] = {}

NEAR_US = 30_000_000
MATCH_US = 864_000_000


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT event_type AS family, count(*) AS n_sims, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def quartile_report(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles and the 99th percentile of each family's statistic, exact and linear."""
    sims = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("family"), "value")
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    return exact_percentiles(sims, ["family"], "value", shares).select("family", F.col("n").alias("n_sims"), *[F.round(c, 6).alias(c) for c in shares])


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL}, m AS (SELECT ev.campaign, event_id, max(least(t - a, b - t)) AS margin FROM ev LEFT JOIN win ON ev.campaign = win.campaign GROUP BY ev.campaign, event_id) "
    f"SELECT campaign, count(*) AS n_events, count(*) FILTER (margin >= 0) AS n_inside, count(*) FILTER (margin >= -{NEAR_US}) AS n_near, count(*) FILTER (margin < -{NEAR_US}) AS n_outside, max(CASE WHEN margin < 0 THEN -margin END) AS most_outside, min(CASE WHEN margin >= 0 THEN margin END) AS least_margin FROM m GROUP BY campaign"
)
def containment_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.containment_stats(ops.margins(frames.events(spark, d), frames.windows(spark, d), NEAR_US))


@query(
    f"WITH {frames.OBSERVED_SQL}, u AS (SELECT campaign, session, EXISTS (SELECT 1 FROM ob WHERE ob.campaign = win.campaign AND ob.session = win.session AND ob.station = 1 AND ob.w > 50) AS done FROM win) "
    "SELECT campaign, count(*) AS n_units, count(*) FILTER (done) AS n_done, count(*) FILTER (NOT done) AS n_pending, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 6) AS share FROM u GROUP BY campaign"
)
def study_status(spark: SparkSession, d: str) -> DataFrame:
    """Progress of each campaign's units of work."""
    done = frames.observed(spark, d).filter("station = 1 AND w > 50").select("campaign", "session").distinct().withColumn("found", F.lit(True))
    units = frames.windows(spark, d).select("campaign", "session").join(done, ["campaign", "session"], "left").withColumn("done", F.coalesce("found", F.lit(False)))
    return units.groupBy("campaign").agg(F.count("*").alias("n_units"), F.count_if("done").alias("n_done"), F.count_if(~F.col("done")).alias("n_pending"), F.round(F.avg(F.col("done").cast("double")), 6).alias("share"))


@query(
    f"WITH {frames.EVENTS_SQL}, fresh AS (SELECT event_id, t FROM ev WHERE event_id % 5 <> 4), old AS (SELECT event_id, t - (5 + event_id % 16) * 1000 AS t0 FROM ev WHERE event_id % 3 = 0) "
    "SELECT count(fresh.event_id) AS n_rows, count(t - t0) AS n_superseded, count(*) FILTER (fresh.event_id IS NULL) AS n_orphans, count(*) FILTER (abs(t - t0) <= 500 OR abs(t - t0) >= 20000) AS n_bad_shift FROM fresh FULL JOIN old ON fresh.event_id = old.event_id"
)
def superseded_audit(spark: SparkSession, d: str) -> DataFrame:
    """What a join with superseded times has to satisfy: no orphans among them, and shifts between 0.5 and 20 ms."""
    events = frames.events(spark, d)
    fresh = events.filter("event_id % 5 <> 4").select("event_id", "t", F.lit(True).alias("kept"))
    old = events.filter("event_id % 3 = 0").select("event_id", (F.col("t") - (5 + F.col("event_id") % 16) * 1000).alias("t0"))
    shift = F.abs(F.col("t") - F.col("t0"))
    return fresh.join(old, "event_id", "full").agg(F.count("kept").alias("n_rows"), F.count(shift).alias("n_superseded"), F.count_if(F.col("kept").isNull()).alias("n_orphans"), F.count_if((shift <= 500) | (shift >= 20_000)).alias("n_bad_shift"))


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL}, m AS (SELECT ev.campaign, event_id, count(win.session) AS n FROM ev LEFT JOIN win ON ev.campaign = win.campaign AND ev.t >= win.a - {MATCH_US} AND ev.t < win.b + {MATCH_US} GROUP BY ev.campaign, event_id) "
    "SELECT campaign, count(*) FILTER (n = 0) AS n_none, count(*) FILTER (n = 1) AS n_one, count(*) FILTER (n > 1) AS n_many FROM m GROUP BY campaign"
)
def session_match_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many events have no session within the tolerance, exactly one, or several; only the found are shuffled by event."""
    events = frames.events(spark, d)
    wide = frames.windows(spark, d).withColumns({"a": F.col("a") - MATCH_US, "b": F.col("b") + MATCH_US})
    each = ops.assign(events, wide).groupBy("campaign", "event_id").agg(F.count("*").alias("n"))
    found = each.groupBy("campaign").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("many"))
    rows = events.groupBy("campaign").agg(F.count("*").alias("all")).join(found, "campaign", "left").fillna(0, ["one", "many"])
    return rows.select("campaign", (F.col("all") - F.col("one") - F.col("many")).alias("n_none"), F.col("one").alias("n_one"), F.col("many").alias("n_many"))
