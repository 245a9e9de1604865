"""Queries of the phase algebra, the lattices and the grid models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import likelihood, timeaxis
from tidewheel.operators import lattice as lat
from tidewheel.plans import frames
from tidewheel.plans.frames import EVENTS_SQL, HOUR_US, OBSERVED_SQL, WINDOWS_SQL, live_before, nlogn, pos_mod, two_bin

Q: dict = {}
SQL: dict[str, str] = {}

PERIODS = [(8 + 2 * i) * HOUR_US + i * 1_234_567 for i in range(8)]
SIGMAS = [HOUR_US, 2 * HOUR_US, 4 * HOUR_US]
TAUS = [HOUR_US * 3 // 2, 3 * HOUR_US, 5 * HOUR_US]
FOLD = 26 * HOUR_US
VISIT_U, VISIT_W = 3 * HOUR_US, 5 * HOUR_US
DAY = "8.64e10::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {WINDOWS_SQL} SELECT campaign, CAST(sum(b - a) AS BIGINT) AS live_us, count(*) AS n_sessions FROM win GROUP BY campaign")
def live_time(spark: SparkSession, d: str) -> DataFrame:
    return frames.windows(spark, d).groupBy("campaign").agg(F.sum(F.col("b") - F.col("a")).alias("live_us"), F.count("*").alias("n_sessions"))


@query(f"WITH {WINDOWS_SQL} SELECT campaign, arg_max(b, a) - min(a) AS span_us FROM win GROUP BY campaign")
def campaign_span(spark: SparkSession, d: str) -> DataFrame:
    return frames.windows(spark, d).groupBy("campaign").agg((F.max_by("b", "a") - F.min("a")).alias("span_us"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, {pos_mod(f't - {40 * HOUR_US}', str(FOLD))} AS phase_us FROM ev")
def fold_phase(spark: SparkSession, d: str) -> DataFrame:
    return frames.events(spark, d).select("event_id", timeaxis.phase(F.col("t"), F.lit(40 * HOUR_US), F.lit(FOLD)).alias("phase_us"))


@query(f"WITH {EVENTS_SQL} SELECT campaign, count(*) FILTER ({pos_mod('t', str(FOLD))} >= {VISIT_U} AND {pos_mod('t', str(FOLD))} < {VISIT_U + VISIT_W} OR {pos_mod('t', str(FOLD))} >= {20 * HOUR_US} AND {pos_mod('t', str(FOLD))} < {22 * HOUR_US}) AS n_in, count(*) AS n FROM ev GROUP BY campaign")
def count_in_phase(spark: SparkSession, d: str) -> DataFrame:
    phi = timeaxis.phase(F.col("t"), F.lit(0), F.lit(FOLD))
    visits = F.array(F.struct(F.lit(VISIT_U).alias("u"), F.lit(VISIT_U + VISIT_W).alias("v")), F.struct(F.lit(20 * HOUR_US).alias("u"), F.lit(22 * HOUR_US).alias("v")))
    rows = frames.events(spark, d).withColumn("phi", phi)
    return rows.groupBy("campaign").agg(F.count_if(F.exists(visits, lambda x: (F.col("phi") >= x["u"]) & (F.col("phi") < x["v"]))).alias("n_in"), F.count("*").alias("n"))


_GRID_SQL = (
    f"per AS (SELECT i AS period_id, CAST((8 + 2 * i) * {HOUR_US} + i * 1234567 AS BIGINT) AS T FROM (SELECT unnest(range(0, {len(PERIODS)}))::BIGINT AS i)), "
    f"sig AS (SELECT i AS sigma_id, CAST(power(2, i) AS BIGINT) * {HOUR_US} AS sigma FROM (SELECT unnest(range(0, {len(SIGMAS)}))::BIGINT AS i)), "
    f"tau AS (SELECT * FROM (VALUES (0::BIGINT, {TAUS[0]}::BIGINT), (1, {TAUS[1]}), (2, {TAUS[2]})) v(tau_id, tau))"
)
_L2_SQL = f"{_GRID_SQL}, lat AS (SELECT campaign, period_id, sigma_id, -1::BIGINT AS tau_id, T, sigma, NULL::BIGINT AS tau, sigma // 2 AS h, CAST(ceil(T / (sigma / 2.0::DOUBLE)) AS BIGINT) AS n_t0 FROM cp, per, sig WHERE sigma * 2 <= T)"
_L3_SQL = f"{_GRID_SQL}, lat AS (SELECT campaign, period_id, sigma_id, tau_id, T, sigma, tau, sigma // 2 AS h, CAST(ceil(T / (sigma / 2.0::DOUBLE)) AS BIGINT) AS n_t0 FROM cp, per, sig, tau WHERE sigma * 2 <= T AND tau * 2 <= T)"
_VISITS_SQL = (
    "vis AS (SELECT *, 0::BIGINT AS u, CASE WHEN tau IS NOT NULL AND tau < sigma THEN least(tau + sigma, T) ELSE least(sigma, T) END AS w FROM lat "
    "UNION ALL SELECT *, tau, least(tau + sigma, T) - tau FROM lat WHERE tau IS NOT NULL AND tau >= sigma)"
)


def _campaigns(spark: SparkSession, d: str) -> DataFrame:
    return frames.campaigns(spark, d).select("campaign")


def _single(spark: SparkSession, d: str) -> DataFrame:
    return lat.lattice(spark, _campaigns(spark, d), PERIODS, SIGMAS)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return lat.lattice(spark, _campaigns(spark, d), PERIODS, SIGMAS, TAUS)


@query(f"WITH {frames.CAMPAIGNS_SQL}, {_L3_SQL}, {_VISITS_SQL} SELECT campaign, period_id, sigma_id, tau_id, CAST(u AS BIGINT) AS u, CAST(w AS BIGINT) AS w FROM vis")
def visit_template(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(*lat.KEY, F.explode("visits").alias("v")).select(*lat.KEY, "v.u", "v.w")


@query(f"WITH {WINDOWS_SQL} SELECT campaign, CAST(sum({live_before(f'b - {5 * HOUR_US}', str(FOLD), str(VISIT_U), str(VISIT_W))} - {live_before(f'a - {5 * HOUR_US}', str(FOLD), str(VISIT_U), str(VISIT_W))}) AS BIGINT) AS e_us FROM win GROUP BY campaign")
def periodic_overlap(spark: SparkSession, d: str) -> DataFrame:
    t, u, w, t0 = F.lit(FOLD), F.lit(VISIT_U), F.lit(VISIT_W), 5 * HOUR_US
    live = timeaxis.live_before(F.col("b") - t0, t, u, w) - timeaxis.live_before(F.col("a") - t0, t, u, w)
    return frames.windows(spark, d).groupBy("campaign").agg(F.sum(live).alias("e_us"))


_ARCS_SQL = (
    f"arc AS (SELECT campaign, {pos_mod('a', str(FOLD))} AS lo, b - a AS len FROM win), "
    f"ed AS (SELECT campaign, lo AS x, 1 AS s FROM arc UNION ALL SELECT campaign, CASE WHEN lo + len <= {FOLD} THEN lo + len ELSE lo + len - {FOLD} END, -1 FROM arc UNION ALL SELECT campaign, 0, 1 FROM arc WHERE lo + len > {FOLD}), "
    "g AS (SELECT campaign, x, CAST(sum(s) AS BIGINT) AS s FROM ed GROUP BY ALL), "
    "c AS (SELECT campaign, x, CAST(sum(s) OVER (PARTITION BY campaign ORDER BY x) AS BIGINT) AS slope, x - lag(x) OVER (PARTITION BY campaign ORDER BY x) AS dx FROM g)"
)


@query(f"WITH {WINDOWS_SQL}, {_ARCS_SQL}, l AS (SELECT *, lag(slope) OVER (PARTITION BY campaign ORDER BY x) AS before FROM c) SELECT campaign, x, slope, CAST(sum(coalesce(dx * before, 0)) OVER (PARTITION BY campaign ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e_us FROM l")
def fold_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative live time over phase: a polyline whose slope is the number of sessions that cover a phase."""
    arcs = frames.windows(spark, d).select("campaign", F.pmod("a", F.lit(FOLD)).alias("lo"), (F.col("b") - F.col("a")).alias("len"))
    end = F.col("lo") + F.col("len")
    edge = F.array(
        F.struct(F.col("lo").alias("x"), F.lit(1).alias("s")),
        F.struct(F.when(end <= FOLD, end).otherwise(end - FOLD).alias("x"), F.lit(-1).alias("s")),
        F.struct(F.lit(0).cast("bigint").alias("x"), F.when(end > FOLD, 1).otherwise(0).alias("s")),
    )
    edges = arcs.select("campaign", F.explode(edge).alias("e")).select("campaign", "e.*").filter("s <> 0").groupBy("campaign", "x").agg(F.sum("s").alias("s"))
    order = Window.partitionBy("campaign").orderBy("x")
    rows = edges.withColumn("slope", F.sum("s").over(order)).withColumn("area", F.coalesce((F.col("x") - F.lag("x").over(order)) * F.lag("slope").over(order), F.lit(0)))
    return rows.select("campaign", "x", "slope", F.sum("area").over(order).alias("e_us"))


@query(f"WITH {EVENTS_SQL}, f AS (SELECT campaign, event_id, {pos_mod('t', str(FOLD))} AS x, 1 AS real FROM ev), twice AS (SELECT * FROM f UNION ALL SELECT campaign, event_id, x + {FOLD}, 0 FROM f), c AS (SELECT *, count(*) OVER (PARTITION BY campaign ORDER BY x RANGE BETWEEN CURRENT ROW AND {HOUR_US - 1} FOLLOWING) AS n_next FROM twice) SELECT campaign, event_id, n_next FROM c WHERE real = 1")
def sliding_phase_count(spark: SparkSession, d: str) -> DataFrame:
    """Events within an hour of phase from each event on, round the circle.

    The circle is dealt into minutes of phase.  An hour from a place in one minute
    ends at the same place of the minute 60 further on, so the count is that of 60
    whole minutes, less the events before the place in the first, plus those before
    it in the last: each event is ranked in two minutes, and no task holds more.
    """
    minute, n = HOUR_US // 60, FOLD // (HOUR_US // 60)
    x = F.pmod("t", F.lit(FOLD))
    folded = frames.events(spark, d).select("campaign", "event_id", F.call_function("div", x, F.lit(minute)).alias("m"), (x % minute).alias("at"))
    counts = folded.groupBy("campaign", "m").agg(F.count("*").alias("c"))
    ahead = counts.withColumn("m", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.pmod(F.col("m") - k, F.lit(n))))).groupBy("campaign", "m").agg(F.sum("c").alias("whole"))
    both = folded.withColumn("real", F.lit(1)).unionByName(folded.withColumns({"m": F.pmod(F.col("m") - 60, F.lit(n)), "real": F.lit(0)}))
    before = Window.partitionBy("campaign", "m").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    ranked = both.withColumns({"own": F.coalesce(F.sum("real").over(before), F.lit(0)), "all": F.count("*").over(before)}).filter("real = 1")
    return ranked.join(ahead, ["campaign", "m"]).select("campaign", "event_id", (F.col("whole") - F.col("own") + F.col("all") - F.col("own")).alias("n_next"))


_P_MIN, _SIGMA_DAY = 1 / 24, 60.0 / 86400
_SPAN_SQL = f"sp AS (SELECT campaign, (arg_max(b, a) - min(a)) / {DAY} AS span FROM win GROUP BY campaign)"
_OCT_SQL = (
    f"{_SPAN_SQL}, o0 AS (SELECT campaign, span, unnest(range(0, CAST(greatest(ceil(log2(span / 3 / {_P_MIN!r}::DOUBLE)), 0) AS BIGINT))) AS octave FROM sp), "
    f"o1 AS (SELECT *, {_P_MIN!r}::DOUBLE * power(2.0::DOUBLE, octave) AS t_lo, least({_P_MIN!r}::DOUBLE * power(2.0::DOUBLE, octave) * 2, span / 3) AS t_hi FROM o0), "
    f"o2 AS (SELECT *, {_SIGMA_DAY!r}::DOUBLE / (2 * t_hi * span) AS df FROM o1), oct AS (SELECT *, CAST(ceil((1 / t_lo - 1 / t_hi) / df) AS BIGINT) AS n_f FROM o2)"
)


def _octaves(spark: SparkSession, d: str) -> DataFrame:
    spans = campaign_span(spark, d).select("campaign", (F.col("span_us") / F.lit(float(timeaxis.DAY_US))).alias("span"))
    return lat.octave_grid(spans, _P_MIN, _SIGMA_DAY)


@query(f"WITH {WINDOWS_SQL}, {_OCT_SQL} SELECT campaign, octave, round(t_lo, 9) AS t_lo, round(t_hi, 9) AS t_hi, n_f FROM oct")
def grid_octaves(spark: SparkSession, d: str) -> DataFrame:
    return _octaves(spark, d).select("campaign", "octave", F.round("t_lo", 9).alias("t_lo"), F.round("t_hi", 9).alias("t_hi"), "n_f")


@query(f"WITH {WINDOWS_SQL}, {_OCT_SQL} SELECT campaign, octave, k, 60.0::DOUBLE * power(2.0::DOUBLE, k) AS sigma_s FROM oct, (SELECT unnest(range(0, 24))::BIGINT AS k) WHERE 120.0::DOUBLE * power(2.0::DOUBLE, k) <= t_hi * 86400")
def sigma_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The visit widths of each campaign's octaves: a minute and its doublings up to half the longest period."""
    return lat.width_ladder(_octaves(spark, d), 60.0).select("campaign", "octave", "k", "sigma_s")


@query(
    f"WITH {WINDOWS_SQL}, {_OCT_SQL} SELECT campaign, octave, k, round(60.0::DOUBLE * power(1.5::DOUBLE, k), 6) AS tau_s FROM oct, (SELECT unnest(range(0, 17))::BIGINT AS k) WHERE 120.0::DOUBLE * power(1.5::DOUBLE, k) <= t_hi * 86400"
)
def tau_grid(spark: SparkSession, d: str) -> DataFrame:
    """The separations of a pair of visits in each campaign's octaves, up to half the longest period."""
    rows = lat.separations(_octaves(spark, d), 60.0, 17)
    return rows.select("campaign", "octave", "k", F.round("tau_s", 6).alias("tau_s"))


@query(f"WITH {frames.CAMPAIGNS_SQL}, {_L3_SQL}, c AS (SELECT *, unnest(range(0, n_t0)) AS i FROM lat) SELECT campaign, period_id, sigma_id, tau_id, i, i * h AS t0_us FROM c")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_t0") - 1)))
    return rows.select(*lat.KEY, "i", (F.col("i") * F.col("h")).alias("t0_us"))


@query(
    f"WITH {WINDOWS_SQL}, {_OCT_SQL}, k AS (SELECT *, CAST(ceil(n_f / 10000.0::DOUBLE) AS BIGINT) AS k FROM oct WHERE octave < 2), i AS (SELECT campaign, octave, k, unnest(range(0, n_f)) AS i FROM k), "
    "n AS (SELECT campaign, octave, i, CASE WHEN i < (count(*) OVER w % k) * (count(*) OVER w // k + 1) THEN i // (count(*) OVER w // k + 1) ELSE (count(*) OVER w % k) + (i - (count(*) OVER w % k) * (count(*) OVER w // k + 1)) // (count(*) OVER w // k) END AS chunk FROM i WINDOW w AS (PARTITION BY campaign, octave)) "
    "SELECT campaign, octave, chunk, min(i) AS first, count(*) AS size FROM n GROUP BY ALL"
)
def chunk_ntile(spark: SparkSession, d: str) -> DataFrame:
    return lat.even_chunks(_octaves(spark, d).filter("octave < 2"), 10_000).select("campaign", "octave", "chunk", "first", "size")


UNIT_COST = 780_000  # fixed value: periods x days x weight of a unit of work


def _costed(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame([("M2", 1.0), ("M3", 5.0)], "model string, weight double")
    return _octaves(spark, d).join(F.broadcast(models)).withColumn("cost", F.col("n_f") * F.col("t_hi") * F.col("weight"))


_COST_SQL = f"{_OCT_SQL}, cost AS (SELECT campaign, octave, model, n_f * t_hi * weight AS cost FROM oct, (VALUES ('M2', 1.0::DOUBLE), ('M3', 5.0::DOUBLE)) m(model, weight))"


@query(f"WITH {WINDOWS_SQL}, {_COST_SQL} SELECT campaign, octave, model, CAST(ceil(cost / {UNIT_COST}) AS BIGINT) AS n_chunks FROM cost")
def chunk_cost(spark: SparkSession, d: str) -> DataFrame:
    return _costed(spark, d).select("campaign", "octave", "model", F.ceil(F.col("cost") / UNIT_COST).cast("bigint").alias("n_chunks"))


@query(f"WITH {WINDOWS_SQL}, {_COST_SQL} SELECT campaign, octave, model, row_number() OVER (PARTITION BY campaign ORDER BY cost DESC, octave, model) AS place FROM cost")
def unit_cost_order(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("campaign").orderBy(F.desc("cost"), "octave", "model")
    return _costed(spark, d).select("campaign", "octave", "model", F.row_number().over(order).cast("bigint").alias("place"))


@query(f"WITH {OBSERVED_SQL}, l AS (SELECT campaign, sum(b - a) / {DAY} AS live FROM win GROUP BY 1), n AS (SELECT campaign, count(*) AS n FROM ob GROUP BY 1) SELECT campaign, n, round({nlogn('n', 'live')}, 6) AS ll FROM n JOIN l USING (campaign)")
def m0_ll(spark: SparkSession, d: str) -> DataFrame:
    live = live_time(spark, d)
    n = frames.observed(spark, d).groupBy("campaign").agg(F.count("*").alias("n"))
    return n.join(live, "campaign").select("campaign", "n", F.round(likelihood.nlogn(F.col("n"), F.col("live_us") / F.lit(float(timeaxis.DAY_US))), 6).alias("ll"))


_PAIR = [(0, 0.1), (3, 0.5), (10, 0.2), (40, 8.0), (7, 0.0)]


@query(f"WITH {OBSERVED_SQL}, l AS (SELECT campaign, sum(b - a) / {DAY} AS live FROM win GROUP BY 1), n AS (SELECT campaign, count(*) AS n FROM ob GROUP BY 1), p AS (SELECT * FROM (VALUES {', '.join(f'({n}::BIGINT, {e}::DOUBLE)' for n, e in _PAIR)}) v(n_in, e_in)) SELECT campaign, n_in, round({two_bin('n_in', 'e_in', 'n', 'live')}, 6) AS ll FROM n JOIN l USING (campaign), p")
def two_bin_ll(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame(_PAIR, "n_in bigint, e_in double")
    n = frames.observed(spark, d).groupBy("campaign").agg(F.count("*").alias("n")).join(live_time(spark, d), "campaign").join(F.broadcast(pairs))
    ll = likelihood.two_bin(F.col("n_in"), F.col("e_in"), F.col("n"), F.col("live_us") / F.lit(float(timeaxis.DAY_US)))
    return n.select("campaign", "n_in", F.round(ll, 6).alias("ll"))


def _scan_sql(lattice: str) -> str:
    visit = f"{pos_mod('ob.t - t.tref - c.i * c.h - c.u', 'c.T')} < c.w"
    x = "- t.tref - c.i * c.h"
    return (
        f"{OBSERVED_SQL}, {lattice}, {_VISITS_SQL}, tot AS (SELECT campaign, CAST(sum(b - a) AS BIGINT) AS live_us, min(a) AS tref FROM win GROUP BY 1), n AS (SELECT campaign, count(*) AS n FROM ob GROUP BY 1), "
        "c AS (SELECT *, unnest(range(0, n_t0)) AS i FROM vis), "
        f"ex AS (SELECT c.campaign, period_id, sigma_id, tau_id, i, any_value(T) AS T, CAST(sum({live_before(f'b {x}', 'c.T', 'c.u', 'c.w')} - {live_before(f'a {x}', 'c.T', 'c.u', 'c.w')}) AS BIGINT) AS e_us FROM c JOIN tot t ON t.campaign = c.campaign JOIN win ON win.campaign = c.campaign GROUP BY ALL), "
        f"ct AS (SELECT c.campaign, period_id, sigma_id, tau_id, i, count(*) AS n_in FROM c JOIN tot t ON t.campaign = c.campaign JOIN ob ON ob.campaign = c.campaign AND {visit} GROUP BY ALL), "
        f"cells AS (SELECT ex.*, coalesce(n_in, 0) AS n_in, round({two_bin('coalesce(n_in, 0)', f'(e_us / {DAY})', 'n', f'(live_us / {DAY})')}, 6) AS ll FROM ex LEFT JOIN ct ON ex.campaign = ct.campaign AND ex.period_id = ct.period_id AND ex.sigma_id = ct.sigma_id AND ex.tau_id = ct.tau_id AND ex.i = ct.i JOIN tot ON tot.campaign = ex.campaign JOIN n ON n.campaign = ex.campaign)"
    )


_BEST_SQL = "SELECT campaign, period_id, sigma_id, tau_id, i, ll, n_in, e_us FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY ll DESC, period_id, sigma_id, tau_id, i) AS rn FROM cells) WHERE rn = 1"
_ORDER = ["period_id", "sigma_id", "tau_id", "i"]


def _cells(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return lat.scan(frames.observed(spark, d).select("campaign", "t"), frames.windows(spark, d).select("campaign", "a", "b"), rows)


def _best(cells: DataFrame) -> DataFrame:
    return lat.first_best(cells.select("campaign", *_ORDER, "ll", "n_in", "e_us"), ["campaign"], _ORDER)


@query(f"WITH {_scan_sql(_L2_SQL)} SELECT campaign, period_id, sigma_id, i, n_in, e_us, ll FROM cells WHERE period_id = 3")
def scan_phases(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, _single(spark, d).filter("period_id = 3")).select("campaign", "period_id", "sigma_id", "i", "n_in", "e_us", "ll")


@query(f"WITH {_scan_sql(_L2_SQL)} {_BEST_SQL}")
def m2_scan(spark: SparkSession, d: str) -> DataFrame:
    return _best(_cells(spark, d, _single(spark, d)))


@query(f"WITH {_scan_sql(_L3_SQL)} {_BEST_SQL}")
def m3_scan(spark: SparkSession, d: str) -> DataFrame:
    return _best(_cells(spark, d, _pairs(spark, d)))


_STREAMS = 8
_STREAM_SQL = (
    f"{_scan_sql(_L2_SQL)}, sn AS (SELECT campaign, user_id % {_STREAMS} AS stream, count(*) AS n FROM ob GROUP BY ALL), "
    f"sc AS (SELECT c.campaign, period_id, sigma_id, i, user_id % {_STREAMS} AS stream, count(*) AS n_in FROM c JOIN tot t ON t.campaign = c.campaign JOIN ob ON ob.campaign = c.campaign AND {pos_mod('ob.t - t.tref - c.i * c.h - c.u', 'c.T')} < c.w GROUP BY ALL), "
    f"sl AS (SELECT sc.*, e_us, round({two_bin('sc.n_in', f'(e_us / {DAY})', 'sn.n', f'(live_us / {DAY})')}, 6) AS ll FROM sc JOIN ex USING (campaign, period_id, sigma_id, i) JOIN sn USING (campaign, stream) JOIN tot USING (campaign))"
)


@query(f"WITH {_STREAM_SQL} SELECT campaign, stream, period_id, sigma_id, i, n_in, e_us, ll FROM (SELECT *, row_number() OVER (PARTITION BY campaign, stream ORDER BY ll DESC, e_us, period_id, sigma_id, i) AS rn FROM sl) WHERE rn = 1")
def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """The single-visit scan of eight streams at once, which share their campaign's exposures."""
    events = frames.observed(spark, d).select("campaign", "t", (F.col("user_id") % _STREAMS).alias("stream"))
    best = lat.scan_streams(events, frames.windows(spark, d).select("campaign", "a", "b"), _single(spark, d))
    return best.select("campaign", "stream", "period_id", "sigma_id", "i", "n_in", "e_us", "ll")


@query(f"WITH {_scan_sql(_L2_SQL)} SELECT campaign, period_id, sigma_id, i, ll FROM (SELECT *, row_number() OVER (PARTITION BY campaign, period_id ORDER BY ll DESC, sigma_id, i) AS rn FROM cells) WHERE rn = 1")
def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d, _single(spark, d)).select("campaign", "period_id", "sigma_id", "i", "ll")
    return lat.first_best(cells, ["campaign", "period_id"], ["sigma_id", "i"])


#: The activity-window grid: periods that are multiples of 24 us, duty 2^-1 ... 2^-4 of 24 steps.
_M1_PERIODS = [((48 + 20 * i) * HOUR_US // 24) * 24 for i in range(8)]
_M1_DUTY = [1, 3, 6, 12]
_M1_SQL = (
    f"lat AS (SELECT campaign, p AS period_id, q AS sigma_id, -1::BIGINT AS tau_id, T, CAST(T // 24 * duty AS BIGINT) AS sigma, NULL::BIGINT AS tau, T // 24 AS h, 24::BIGINT AS n_t0 FROM cp, "
    f"(SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {t}::BIGINT)' for i, t in enumerate(_M1_PERIODS))}) v(p, T)), (SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {k}::BIGINT)' for i, k in enumerate(_M1_DUTY))}) v(q, duty)))"
)


def _activity(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(list(enumerate(_M1_PERIODS)), "period_id bigint, period_us bigint")
    k = spark.createDataFrame(list(enumerate(_M1_DUTY)), "sigma_id bigint, duty int")
    rows = _campaigns(spark, d).join(F.broadcast(t.join(F.broadcast(k)))).withColumns({"tau_id": F.lit(-1).cast("bigint"), "h": (F.col("period_us") / 24).cast("bigint"), "n_t0": F.lit(24).cast("bigint")})
    return rows.withColumn("visits", F.array(F.struct(F.lit(0).cast("bigint").alias("u"), (F.col("h") * F.col("duty")).alias("w"))))


@query(f"WITH {_scan_sql(_M1_SQL)} {_BEST_SQL}")
def m1_scan(spark: SparkSession, d: str) -> DataFrame:
    return _best(_cells(spark, d, _activity(spark, d)))


@query(f"WITH {_scan_sql(_M1_SQL)} SELECT cells.campaign, period_id, sigma_id, i, round((CASE WHEN n_in = 0 THEN 0 ELSE n_in * ln(20.0::DOUBLE) END) - 20.0::DOUBLE * (e_us / {DAY}) + (CASE WHEN n - n_in = 0 THEN 0 ELSE (n - n_in) * ln(60.0::DOUBLE) END) - 60.0::DOUBLE * ((live_us - e_us) / {DAY}), 6) AS ll FROM cells JOIN tot USING (campaign) JOIN n USING (campaign) WHERE period_id < 2")
def m1_ll_explicit(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d, _activity(spark, d).filter("period_id < 2"))
    day = F.lit(float(timeaxis.DAY_US))
    ll = likelihood.explicit_two_bin(F.col("n_in"), F.col("e_us") / day, F.lit(20.0), F.col("n") - F.col("n_in"), (F.col("live_us") - F.col("e_us")) / day, F.lit(60.0))
    return cells.select("campaign", "period_id", "sigma_id", "i", F.round(ll, 6).alias("ll"))
