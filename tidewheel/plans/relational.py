"""Queries of the relational core: scans, joins and cleaning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import arrival, timeaxis
from tidewheel.functions.astronomy import SITES_XYZ
from tidewheel.functions.noise import normal
from tidewheel.operators import events as ops
from tidewheel.plans import frames
from tidewheel.sources import text

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {frames.EVENTS_SQL} SELECT campaign, event_id, t FROM ev")
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    return frames.events(spark, d).select("campaign", "event_id", "t")


@query(f"WITH {frames.EVENTS_SQL} SELECT event_id, t, w FROM ev WHERE campaign = 'click' AND station = 0")
def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return frames.events(spark, d).filter("campaign = 'click' AND station = 0").select("event_id", "t", "w")


@query("SELECT event_id, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) AS start_us, CAST(epoch_us(ts) - 1704067200000000 + user_id * 60000000 AS BIGINT) AS end_us FROM events WHERE contains(props, '\"k\": 1')")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").filter(F.col("props").contains('"k": 1'))
    start = timeaxis.micros(F.col("ts"))
    return rows.select("event_id", start.alias("start_us"), (start + F.col("user_id") * 60_000_000).alias("end_us"))


@query(
    f"WITH {frames.EVENTS_SQL} SELECT campaign, 'E' || CAST(event_id AS VARCHAR) AS ident, t, w AS weight FROM ev "
    "UNION ALL SELECT 'orders', 'O-' || CAST(o_orderkey AS VARCHAR), CAST(epoch_us(o_orderdate) - 1704067200000000 AS BIGINT), NULL FROM orders"
)
def union_campaigns(spark: SparkSession, d: str) -> DataFrame:
    events = frames.events(spark, d).select("campaign", F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ident"), "t", F.col("w").alias("weight"))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    orders = orders.select(F.lit("orders").alias("campaign"), F.concat_ws("-", F.lit("O"), F.col("o_orderkey").cast("string")).alias("ident"), timeaxis.micros(F.col("o_orderdate")).alias("t"), F.lit(None).cast("double").alias("weight"))
    return events.unionByName(orders)


@query("SELECT event_id, epoch_us(ts) / 8.64e10::DOUBLE + 40587 AS mjd FROM events")
def mjd_from_ts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", timeaxis.mjd(F.col("ts")).alias("mjd"))


@query("SELECT o_orderkey, epoch_us(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, o_custkey % 60, (o_orderkey % 60)::DOUBLE)) / 8.64e10::DOUBLE + 40587 AS mjd FROM orders")
def mjd_from_parts(spark: SparkSession, d: str) -> DataFrame:
    rows, day = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderdate")
    parts = (F.year(day), F.month(day), F.day(day), (F.col("o_orderkey") % 24).cast("int"), (F.col("o_custkey") % 60).cast("int"), (F.col("o_orderkey") % 60).cast("decimal(16,6)"))
    return rows.select("o_orderkey", timeaxis.mjd_from_parts(*parts).alias("mjd"))


@query(
    "SELECT c_custkey, round((c_custkey % 24 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59 + 0.5::DOUBLE) / 3600.0::DOUBLE) * 15, 9) AS ra_deg, "
    "round((c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59 + 0.25::DOUBLE) / 3600.0::DOUBLE) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END, 9) AS dec_deg FROM customer"
)
def sexagesimal_to_deg(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet")
    texts = rows.selectExpr(
        "c_custkey",
        "format_string('%02d:%02d:%02d.5', c_custkey % 24, c_custkey % 60, c_custkey % 59) AS ra",
        "format_string('%s%02d:%02d:%02d.25', if(c_custkey % 2 = 0, '-', '+'), c_custkey % 90, c_custkey % 60, c_custkey % 59) AS dec",
    )
    return texts.select("c_custkey", F.round(timeaxis.sexagesimal_degrees(F.col("ra"), True), 9).alias("ra_deg"), F.round(timeaxis.sexagesimal_degrees(F.col("dec"), False), 9).alias("dec_deg"))


_LINES = "format_string('B%06d %-8s %013d', event_id, event_type, unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000)"


@query("SELECT event_id AS burst, event_type AS label, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) // 1000000 AS second FROM events WHERE event_id % 5 < 4")
def regex_extract_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").selectExpr(f"if(event_id % 5 < 4, {_LINES}, concat('# ', event_type)) AS line")
    found = text.regex_rows(lines, r"^B(\d{6,}) (\w+)\s+(\d+)\d{6}$", {"burst": "bigint", "label": "string", "second": "bigint"})
    return found


@query("SELECT event_id AS burst, event_type AS label, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) AS at_us FROM events WHERE event_id < 1000000")
def fixed_width_substr(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").filter("event_id < 1000000").selectExpr(f"{_LINES} AS line")
    layout = text.byte_layout(["   2-  7  I6   ---  burst", "   9- 16  A8   ---  label", "  18- 30  I13  us   at_us"])
    return text.fixed_width_rows(lines.filter(F.col("line").rlike(r"^B\d")), layout, {"burst": "bigint", "label": "string", "at_us": "bigint"})


@query(
    "WITH l AS (SELECT user_id % 8 AS part, event_id AS line_no, event_type, value, CASE WHEN event_id % 97 < 8 THEN 1 WHEN event_id % 97 >= 56 AND event_id % 97 < 64 THEN -1 ELSE 0 END AS mark FROM events), "
    "r AS (SELECT *, last_value(CASE WHEN mark <> 0 THEN mark END IGNORE NULLS) OVER (PARTITION BY part ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM l) "
    "SELECT part, line_no, event_type AS label, value FROM r WHERE inside = 1 AND mark = 0"
)
def parse_delimited_cells(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "user_id % 8 AS part",
        "event_id AS line_no",
        r"CASE WHEN event_id % 97 < 8 THEN '\\begin{longtable}' WHEN event_id % 97 >= 56 AND event_id % 97 < 64 THEN '\\end{longtable}' ELSE concat('20240101 & $', event_type, '$ & ', CAST(value AS STRING), ' \\\\ % note') END AS line",
    )
    cells = text.table_cells(lines, "part", "line_no", r"\\begin\{longtable\}", r"\\end\{longtable\}", r"^\s*\d{8}\s*&")
    return cells.select("part", "line_no", F.col("cells")[1].alias("label"), F.col("cells")[2].cast("double").alias("value"))


@query(f"WITH {frames.EVENTS_SQL}, h AS (SELECT campaign, event_id, t, CASE WHEN event_id % 7 = 0 THEN t // 86400000000 END AS day FROM ev) SELECT campaign, event_id, last_value(day IGNORE NULLS) OVER (PARTITION BY campaign ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS day FROM h")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.events(spark, d).selectExpr("campaign", "event_id", "t", "CASE WHEN event_id % 7 = 0 THEN t div 86400000000 END AS day")
    return ops.forward_fill(rows, "day", ["campaign"], ["t", "event_id"]).select("campaign", "event_id", "day")


@query(f"WITH {frames.EVENTS_SQL} SELECT campaign, event_id, t - lag(t) OVER (PARTITION BY campaign ORDER BY t, event_id) AS gap FROM ev")
def waiting_times(spark: SparkSession, d: str) -> DataFrame:
    return ops.waiting_times(frames.events(spark, d), ["campaign"]).select("campaign", "event_id", "gap")


@query(
    f"WITH {frames.EVENTS_SQL}, f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY campaign ORDER BY t, event_id) < 600000000 THEN 0 ELSE 1 END AS opens FROM ev), "
    "g AS (SELECT *, sum(opens) OVER (PARTITION BY campaign ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY campaign, grp ORDER BY w DESC, t, event_id) AS rn, count(*) OVER (PARTITION BY campaign, grp) AS n_merged FROM g) "
    "SELECT campaign, CAST(grp AS BIGINT) AS grp, event_id, t, w, n_merged FROM r WHERE rn = 1"
)
def merge_events_gap(spark: SparkSession, d: str) -> DataFrame:
    return ops.merge_gaps(frames.events(spark, d), ["campaign"], 600_000_000)


@query("WITH i AS (SELECT *, event_type || '-' || CAST(user_id AS VARCHAR) AS base FROM events) SELECT base, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY value DESC, event_id) AS rn FROM i) WHERE rn = 1")
def dedup_best_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.concat_ws("-", "event_type", "user_id", "event_id").alias("id"), "event_id", "value")
    rows = rows.withColumn("base", F.regexp_extract("id", "^(.*)-[^-]*$", 1))
    return ops.best_by_id(rows, ["base"], F.col("value"), [F.col("event_id")]).select("base", "event_id", "value")


@query("SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def ckpt_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", "user_id", "event_id", "value")
    return ops.latest_by_key(rows, ["event_type", "user_id"], ["event_id"])


@query("SELECT event_type AS family, user_id AS sim, file_no, event_id, value FROM (SELECT *, event_id % 4 AS file_no, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 4 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def collate_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type AS family", "user_id AS sim", "event_id % 4 AS file_no", "event_id", "value")
    return ops.latest_by_key(rows, ["family", "sim"], ["file_no", "event_id"])


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL} SELECT ev.campaign, event_id, max(least(t - a, b - t)) AS margin, max(least(t - a, b - t)) >= 0 AS inside, max(least(t - a, b - t)) >= -30000000 AS near FROM ev LEFT JOIN win ON ev.campaign = win.campaign GROUP BY ev.campaign, event_id"
)
def containment_margin(spark: SparkSession, d: str) -> DataFrame:
    return ops.margins(frames.events(spark, d), frames.windows(spark, d), 30_000_000).drop("t")


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL} SELECT ev.campaign, event_id, session, t < b AS inside FROM ev ASOF LEFT JOIN win ON ev.campaign = win.campaign AND ev.t >= win.a"
)
def asof_session(spark: SparkSession, d: str) -> DataFrame:
    return ops.as_of(frames.events(spark, d), frames.windows(spark, d)).drop("t")


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL}, m AS (SELECT ev.campaign, event_id, session, count(*) OVER (PARTITION BY ev.campaign, event_id) AS n FROM ev JOIN win ON ev.campaign = win.campaign AND ev.t >= win.a - 864000000 AND ev.t < win.b + 864000000) SELECT campaign, event_id, session FROM m WHERE n = 1"
)
def unique_session_match(spark: SparkSession, d: str) -> DataFrame:
    wide = frames.windows(spark, d).withColumns({"a": F.col("a") - 864_000_000, "b": F.col("b") + 864_000_000})
    found = ops.assign(frames.events(spark, d), wide)
    once = found.groupBy("campaign", "event_id").agg(F.count("*").alias("n"), F.min("session").alias("session"))
    return once.filter("n = 1").drop("n")


_LAYERS = [(3, 0, 0), (2, 1, 5), (1, 2, 9)]  # every so many days, from day, shifted by hours


def _layer(windows: DataFrame, name: str, every: int, start: int, hours: int) -> DataFrame:
    shift = hours * frames.HOUR_US
    return windows.filter(F.col("session") % every == start % every).select("campaign", F.lit(name).alias("layer"), "session", (F.col("a") + shift).alias("a"), (F.col("b") + shift).alias("b"))


def _layer_sql(name: str, every: int, start: int, hours: int) -> str:
    return f"SELECT campaign, '{name}' AS layer, session, a + {hours * frames.HOUR_US} AS a, b + {hours * frames.HOUR_US} AS b FROM win WHERE session % {every} = {start % every}"


@query(
    f"WITH {frames.WINDOWS_SQL}, p AS ({_layer_sql('P', *_LAYERS[0])}), k0 AS ({_layer_sql('K', *_LAYERS[1])}), n0 AS ({_layer_sql('N', *_LAYERS[2])}), "
    "k AS (SELECT * FROM k0 WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.campaign = k0.campaign AND k0.a < p.b AND p.a < k0.b)), pk AS (SELECT * FROM p UNION ALL SELECT * FROM k) "
    "SELECT * FROM pk UNION ALL SELECT * FROM n0 WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.campaign = n0.campaign AND n0.a < pk.b AND pk.a < n0.b)"
)
def interval_precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    windows = frames.windows(spark, d)
    return ops.precedence_merge([_layer(windows, name, *rule) for name, rule in zip("PKN", _LAYERS, strict=True)])


_ADJACENT = 43_200_000  # 5e-4 days


def _precedence_layers(windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three layers in which every verdict occurs: some of the third begin just after one of the second ends."""
    shift = 5 * frames.HOUR_US + 20_000_000
    after = windows.filter("session % 4 = 1").select("campaign", F.lit("N").alias("layer"), (100 + F.col("session")).alias("session"), (F.col("b") + shift).alias("a"), (F.col("b") + shift + frames.HOUR_US).alias("b"))
    return _layer(windows, "P", 3, 0, 0), _layer(windows, "K", 2, 1, 5), _layer(windows, "N", 5, 2, 9).unionByName(after)


@query(
    f"WITH {frames.WINDOWS_SQL}, p AS ({_layer_sql('P', 3, 0, 0)}), k0 AS ({_layer_sql('K', 2, 1, 5)}), n0 AS ({_layer_sql('N', 5, 2, 9)} UNION ALL SELECT campaign, 'N', 100 + session, b + {5 * frames.HOUR_US + 20_000_000}, b + {6 * frames.HOUR_US + 20_000_000} FROM win WHERE session % 4 = 1), "
    "k1 AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.campaign = k0.campaign AND k0.a < p.b AND p.a < k0.b) AS gone FROM k0), n1 AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.campaign = n0.campaign AND n0.a < p.b AND p.a < n0.b) AS gone FROM n0), "
    f"k2 AS (SELECT *, EXISTS (SELECT 1 FROM n1 WHERE NOT n1.gone AND n1.campaign = k1.campaign AND k1.a < n1.b AND n1.a < k1.b) AS pinned, EXISTS (SELECT 1 FROM n1 WHERE NOT n1.gone AND n1.campaign = k1.campaign AND abs(n1.a - k1.b) < {_ADJACENT}) AS touched FROM k1), "
    f"n2 AS (SELECT *, EXISTS (SELECT 1 FROM k2 WHERE NOT k2.gone AND k2.campaign = n1.campaign AND (pinned AND n1.a < k2.b AND k2.a < n1.b OR NOT pinned AND abs(n1.a - k2.b) < {_ADJACENT})) AS pins FROM n1) "
    "SELECT *, 'kept' AS verdict FROM p UNION ALL SELECT campaign, layer, session, a, b, CASE WHEN gone THEN 'consumed' WHEN pinned OR touched THEN 'kept' ELSE 'dropped' END FROM k2 UNION ALL SELECT campaign, layer, session, a, b, CASE WHEN gone OR pins THEN 'consumed' ELSE 'kept' END FROM n2"
)
def precedence_pinned(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of three logs by precedence: the second needs one of the third, over it or beginning at its end."""
    return ops.pinned_merge(*_precedence_layers(frames.windows(spark, d)), _ADJACENT)


_JITTER_US = 10_000_000


def _uniform_sql(counter: int) -> str:
    return f"((('0x' || substr(md5('{counter}:' || CAST(event_id AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL}, j AS (SELECT campaign, event_id, t + CAST(round({_JITTER_US} * sqrt(-2 * ln({_uniform_sql(1)})) * cos({2 * math.pi!r}::DOUBLE * {_uniform_sql(2)})) AS BIGINT) AS t FROM ev), "
    "o AS (SELECT j.*, win.b AS own_b FROM j ASOF LEFT JOIN win ON j.campaign = win.campaign AND j.t >= win.a), "
    "n AS (SELECT o.*, win.a AS next_a FROM o ASOF LEFT JOIN win ON o.campaign = win.campaign AND o.t < win.a) "
    "SELECT campaign, event_id, CASE WHEN own_b IS NULL OR next_a - t < t - least(t, own_b) THEN next_a ELSE least(t, own_b) END AS t FROM n"
)
def jitter_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Events moved by normal noise of ten seconds, then into the nearer of the sessions before and after."""
    rows = frames.events(spark, d).select("campaign", "event_id", "t")
    moved = F.col("t") + F.round(_JITTER_US * normal(1, F.col("event_id"))).cast("bigint")
    return ops.settled(rows.withColumn("t", moved), frames.windows(spark, d))


@query(
    f"WITH {frames.EVENTS_SQL}, old AS (SELECT event_id, t - 5000 - (event_id % 15) * 1000 AS t0 FROM ev WHERE event_id % 3 = 0) SELECT ev.event_id, t, t0 AS t_superseded, round((t - t0) / 1000.0::DOUBLE, 3) AS shift_ms FROM ev LEFT JOIN old ON ev.event_id = old.event_id"
)
def dedup_superseded_join(spark: SparkSession, d: str) -> DataFrame:
    new = frames.events(spark, d).select("event_id", "t")
    old = new.filter("event_id % 3 = 0").select("event_id", (F.col("t") - 5000 - (F.col("event_id") % 15) * 1000).alias("t_superseded"))
    return new.join(old, "event_id", "left").select("event_id", "t", "t_superseded", F.round((F.col("t") - F.col("t_superseded")) / 1000, 3).alias("shift_ms"))


@query(
    f"WITH {frames.OBSERVED_SQL}, c AS (SELECT campaign, session, count(*) AS n FROM ob GROUP BY ALL) SELECT win.campaign, win.session, 10 + win.session % 5 AS declared, coalesce(n, 0) AS n_found, coalesce(n, 0) = 10 + win.session % 5 AS agrees FROM win LEFT JOIN c USING (campaign, session)"
)
def tally_reconcile(spark: SparkSession, d: str) -> DataFrame:
    found = frames.observed(spark, d).groupBy("campaign", "session").agg(F.count("*").alias("n"))
    rows = frames.windows(spark, d).select("campaign", "session", (10 + F.col("session") % 5).alias("declared")).join(found, ["campaign", "session"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("campaign", "session", "declared", n.alias("n_found"), (n == F.col("declared")).alias("agrees"))


@query(f"WITH {frames.OBSERVED_SQL} SELECT campaign, session FROM win WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.campaign = win.campaign AND ob.session = win.session AND ob.station = 1 AND ob.w > 50)")
def pending_units_anti(spark: SparkSession, d: str) -> DataFrame:
    done = frames.observed(spark, d).filter("station = 1 AND w > 50").select("campaign", "session").distinct()
    return frames.windows(spark, d).select("campaign", "session").join(done, ["campaign", "session"], "left_anti")


@query(f"WITH {frames.EVENTS_SQL} SELECT campaign, event_id FROM ev WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND t // 86400000000 NOT IN (SELECT session FROM (SELECT unnest(range(0, 30, 7)) AS session))")
def semi_anti_events(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.events(spark, d).withColumn("day", F.call_function("div", F.col("t"), F.lit(timeaxis.DAY_US)))
    users = spark.read.parquet(f"{d}/orders.parquet").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("user_id"))
    return rows.join(users, "user_id", "left_semi").join(spark.range(0, 30, 7).withColumnRenamed("id", "day"), "day", "left_anti").select("campaign", "event_id")


@query("SELECT event_type AS name, count(*) AS n_rows, CASE WHEN event_type = 'view' THEN NULL ELSE 2000 END AS expected, CASE WHEN event_type = 'view' THEN true ELSE count(*) = 2000 END AS conforms FROM events GROUP BY event_type")
def row_count_check(spark: SparkSession, d: str) -> DataFrame:
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n_rows"))
    expected = F.when(F.col("name") != "view", 2000)
    return counts.select("name", "n_rows", expected.alias("expected"), F.coalesce(F.col("n_rows") == expected, F.lit(True)).alias("conforms"))


@query(
    f"WITH {frames.EVENTS_SQL}, days AS (SELECT campaign, t // 86400000000 AS day, sha256(string_agg(CAST(event_id AS VARCHAR) || ',' || CAST(t AS VARCHAR), ';' ORDER BY t, event_id)) AS h FROM ev GROUP BY ALL) SELECT campaign, sha256(string_agg(h, '' ORDER BY day)) AS sha256, count(*) AS n_days FROM days GROUP BY campaign"
)
def provenance_sha256(spark: SparkSession, d: str) -> DataFrame:
    """A hash tree: each day's rows in order, then the days' hashes, so no task holds more than a day."""
    rows = frames.events(spark, d).withColumn("day", F.call_function("div", F.col("t"), F.lit(timeaxis.DAY_US)))
    line = F.concat_ws(",", "event_id", "t")
    days = rows.groupBy("campaign", "day").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", line.alias("line")))).alias("l"))
    days = days.select("campaign", "day", F.sha2(F.array_join(F.col("l.line"), ";").cast("binary"), 256).alias("h"))
    whole = days.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("day", "h"))).alias("l"))
    return whole.select("campaign", F.sha2(F.array_join(F.col("l.h"), "").cast("binary"), 256).alias("sha256"), F.size("l").cast("bigint").alias("n_days"))


@query(f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL}, e AS (SELECT campaign, count(*) AS n_events FROM ev GROUP BY 1), w AS (SELECT campaign, count(*) AS n_sessions FROM win GROUP BY 1) SELECT campaign, n_events, n_sessions, n_sessions = 30 AS conforms FROM e JOIN w USING (campaign)")
def scan_manifest_check(spark: SparkSession, d: str) -> DataFrame:
    n = frames.events(spark, d).groupBy("campaign").agg(F.count("*").alias("n_events"))
    s = frames.windows(spark, d).groupBy("campaign").agg(F.count("*").alias("n_sessions"))
    return n.join(s, "campaign").withColumn("conforms", F.col("n_sessions") == frames.DAYS)


@query(
    f"WITH {frames.EVENTS_SQL}, {frames.WINDOWS_SQL}, f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY campaign ORDER BY t, event_id) < 600000000 THEN 0 ELSE 1 END AS opens FROM ev), "
    "g AS (SELECT *, sum(opens) OVER (PARTITION BY campaign ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f), "
    "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign, grp ORDER BY w DESC, t, event_id) AS rn FROM g) WHERE rn = 1), "
    "m AS (SELECT r.campaign, event_id, t, max(least(t - a, b - t)) AS margin FROM r JOIN win ON r.campaign = win.campaign GROUP BY ALL) "
    "SELECT campaign, event_id, t, margin, count(*) OVER (PARTITION BY campaign) AS n_kept FROM m WHERE margin >= -30000000"
)
def build_inputs(spark: SparkSession, d: str) -> DataFrame:
    merged = ops.merge_gaps(frames.events(spark, d), ["campaign"], 600_000_000)
    kept = ops.margins(merged, frames.windows(spark, d), 30_000_000).filter("near").select("campaign", "event_id", "t", "margin")
    return kept.join(kept.groupBy("campaign").agg(F.count("*").alias("n_kept")), "campaign").select("campaign", "event_id", "t", "margin", "n_kept")


@query("SELECT event_id, ('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 2))::BIGINT % 2 AS half FROM events")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.col("event_id").cast("string").cast("binary"), 256)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.conv(F.substring(digest, 1, 2), 16, 10).cast("bigint") % 2).alias("half"))


_STATIONS = ("tianma65", "torun", "onsala85")
_OFF = "(ascii(event_type) + length(event_type)) % 16"
_TIMES_SQL = (
    f"site AS (SELECT * FROM (VALUES {', '.join(str((k, *SITES_XYZ[s])) for k, s in enumerate(_STATIONS))}) s(station, x, y, z)), "
    f"times AS (SELECT event_id, epoch_us(ts) / 8.64e10::DOUBLE + 40587 - 365.25::DOUBLE * (user_id % 40) AS utc, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, 1.5::DOUBLE + 15 * ({_OFF}) AS ra, 5.0::DOUBLE * ({_OFF}) - 30 AS dec FROM events JOIN site ON site.station = user_id % 3)"
)


@query(f"WITH {_TIMES_SQL}, {arrival.arrival_sql('times')} SELECT event_id, round(offset_s, 6) AS offset_s FROM arrived")
def arrival_times(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to the barycentre of each event, over forty years back so that all kinds of leap seconds occur, for three sites."""
    known = arrival.sites(spark).filter(F.col("site").isin(*_STATIONS))
    station = F.coalesce(*[F.when(F.col("site") == s, k) for k, s in enumerate(_STATIONS)])
    utc = timeaxis.mjd(F.col("ts")) - 365.25 * (F.col("user_id") % 40)
    times = spark.read.parquet(f"{d}/events.parquet").select("event_id", utc.alias("utc"), (F.col("user_id") % 3).alias("station"), (1.5 + 15 * F.expr(_OFF)).alias("ra"), (5.0 * F.expr(_OFF) - 30).alias("dec"))
    times = times.join(F.broadcast(known.withColumn("station", station)), "station")
    return arrival.with_arrival(times).select("event_id", F.round("offset_s", 6).alias("offset_s"))
