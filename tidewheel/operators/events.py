"""Event cleaning and joining with sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.sources.shared import cut


BUCKET_US = 3_600_000_000  # an hour: rows of a campaign are ordered within such buckets, and only their ends across them
BUCKET = "_bucket"


def bucketed(rows: DataFrame, t: str = "t", unit: int = BUCKET_US) -> DataFrame:
    return rows.withColumn(BUCKET, F.floor(F.col(t) / unit))


def carried(rows: DataFrame, by: Sequence[str], kept: Column, order: Sequence[Column]) -> DataFrame:
    """Joins to each row `_carried`: the last non-null `kept`, by `order`, of all earlier buckets of its group.

    What crosses buckets is one row for each of them, so a group with any number of
    rows is ordered in as many tasks as it has buckets.
    """
    ends = rows.groupBy(*by, BUCKET).agg(F.max_by(kept, F.when(kept.isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ends.select(*by, BUCKET, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")), [*by, BUCKET])


def running_totals(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds `upto_<column>`: the sum of each column up to and with the row, over buckets and `order`."""
    sums = rows.groupBy(*by, BUCKET).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, BUCKET, *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    own = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*by, BUCKET])
    return joined.withColumns({f"upto_{c}": F.sum(c).over(own) + F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def islands(intervals: DataFrame, by: Sequence[str], low: str = "lo", high: str = "hi") -> DataFrame:
    """Adds `island`, the number of the run of overlapping or adjoining closed intervals of whole numbers, to rows that have BUCKET.

    Buckets are in the order of `low`.  Rows are ordered within a bucket; only its
    greatest end and its number of islands cross over.
    """
    ends = intervals.groupBy(*by, BUCKET).agg(F.max(high).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.join(ends.select(*by, BUCKET, F.max("_end").over(earlier).alias("_end")), [*by, BUCKET])
    own = Window.partitionBy(*by, BUCKET).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max(high).over(own), F.col("_end"))
    rows = rows.withColumn("opens", F.when(F.col(low) <= reached + 1, 0).otherwise(1)).drop("_end")
    return running_totals(rows, by, [low, high], ["opens"]).withColumnRenamed("upto_opens", "island").drop("opens")


def _with_previous(events: DataFrame, by: Sequence[str], t: str, tie: str) -> DataFrame:
    """Adds `_previous`: the time of the event before in the group."""
    own = Window.partitionBy(*by, BUCKET).orderBy(t, tie)
    rows = carried(bucketed(events, t), by, F.col(t), [F.col(t), F.col(tie)])
    return rows.withColumn("_previous", F.coalesce(F.lag(t).over(own), F.col("_carried"))).drop("_carried")


def waiting_times(events: DataFrame, by: Sequence[str], t: str = "t", tie: str = "event_id") -> DataFrame:
    """Adds `gap`: the time since the event before in the group (null for the first)."""
    return _with_previous(events, by, t, tie).withColumn("gap", F.col(t) - F.col("_previous")).drop("_previous", BUCKET)


def merge_gaps(events: DataFrame, by: Sequence[str], gap: int, t: str = "t", weight: str = "w", ident: str = "event_id") -> DataFrame:
    """Merges events less than `gap` after the one before; the brightest, and of those the first, stands for its group."""
    rows = _with_previous(events, by, t, ident).withColumn("opens", F.when(F.col(t) - F.col("_previous") < gap, 0).otherwise(1))
    rows = running_totals(rows, by, [t, ident], ["opens"]).withColumnRenamed("upto_opens", "grp")
    brightest = F.max(F.struct(F.col(weight).alias("w"), (-F.col(t)).alias("nt"), (-F.col(ident)).alias("ni")))
    merged = rows.groupBy(*by, "grp").agg(brightest.alias("b"), F.count("*").alias("n_merged"))
    return merged.select(*by, "grp", (-F.col("b.ni")).alias(ident), (-F.col("b.nt")).alias(t), F.col("b.w").alias(weight), "n_merged")


def best_by_id(rows: DataFrame, key: Sequence[str], score: Column, order: Sequence[Column]) -> DataFrame:
    """The row of the greatest score for each key; of equal ones the first by `order`."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(score.desc(), *order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`: one map-side-combined maximum, no window."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("r")
    return rows.groupBy(*key).agg(last).select(*key, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def margins(events: DataFrame, windows: DataFrame, tolerance: int, by: str = "campaign") -> DataFrame:
    """Each event's greatest signed distance inside a window of its campaign, whether it is inside, and whether within `tolerance`.

    Windows may overlap.  A campaign's windows, which the calendar bounds, are one
    array, and an event's margin is a maximum over it: events are neither multiplied
    nor shuffled for it.
    """
    spans = windows.groupBy(by).agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    margin = F.array_max(F.transform("_spans", lambda w: F.least(F.col("t") - w["a"], w["b"] - F.col("t"))))
    rows = events.join(spans, by, "left").select(by, "event_id", "t", margin.alias("margin"))
    return rows.withColumn("inside", F.coalesce(F.col("margin") >= 0, F.lit(False))).withColumn("near", F.coalesce(F.col("margin") >= -tolerance, F.lit(False)))


def containment_stats(judged: DataFrame, by: str = "campaign") -> DataFrame:
    """Of the rows of `margins`, by campaign: events, those inside, near and neither, the furthest outside and the least margin inside."""
    outside = F.when(~F.col("inside"), -F.col("margin"))
    return judged.groupBy(by).agg(F.count("*").alias("n_events"), F.count_if("inside").alias("n_inside"), F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_outside"), F.max(outside).alias("most_outside"), F.min(F.when(F.col("inside"), F.col("margin"))).alias("least_margin"))


def assign(events: DataFrame, windows: DataFrame, by: str = "campaign", unit: int = 86_400_000_000) -> DataFrame:
    """Pairs of event and half-open window [a, b) that holds it, by an equi-join on the days that a window touches."""
    dealt = windows.withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / unit), F.floor((F.col("b") - 1) / unit))))
    return events.withColumn("day", F.floor(F.col("t") / unit)).join(dealt, [by, "day"]).filter("t >= a AND t < b").drop("day")


def as_of(events: DataFrame, windows: DataFrame, by: str = "campaign") -> DataFrame:
    """The window that began last at or before each event, by one union and one window pass; null if none did."""
    starts = windows.select(by, F.col("a").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("event_id"), F.struct("session", "a", "b").alias("s"))
    both = bucketed(starts.unionByName(events.select(by, "t", F.lit(1).alias("kind"), "event_id", F.lit(None).cast(starts.schema["s"].dataType).alias("s"))))
    order = Window.partitionBy(by, BUCKET).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = carried(both, [by], F.col("s"), [F.col("t"), F.col("kind")])
    found = found.withColumn("s", F.coalesce(F.last("s", ignorenulls=True).over(order), F.col("_carried"))).filter("kind = 1")
    return found.select(by, "event_id", "t", F.col("s.session").alias("session"), (F.col("t") < F.col("s.b")).alias("inside"))


DAY_BUCKET = 86_400_000_000


def overlaps(intervals: DataFrame, others: DataFrame, by: str = "campaign") -> DataFrame:
    """Adds `hit` to intervals (by, a, b): whether one of `others` (by, a, b) strictly overlaps it.

    One overlaps if the greatest end of those that begin before b lies after a.  That
    is a running maximum over all end points in order, within days of a campaign and
    from the days' maxima, so intervals are not joined with each other.
    """
    columns = intervals.columns
    asked = intervals.select(F.col(by).alias("_by"), F.col("b").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_end"), F.struct(*columns).alias("_row"))
    there = others.select(F.col(by).alias("_by"), F.col("a").cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.col("b").cast("bigint").alias("_end"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    both = bucketed(asked.unionByName(there), "_at", DAY_BUCKET)
    ends = both.groupBy("_by", BUCKET).agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy("_by").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    both = both.join(ends.select("_by", BUCKET, F.max("_end").over(earlier).alias("_reached")), ["_by", BUCKET])
    own = Window.partitionBy("_by", BUCKET).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.greatest(F.max("_end").over(own), F.col("_reached"))
    both = both.withColumn("_far", reached).filter("_kind = 0")
    return both.select("_row.*", F.coalesce(F.col("_far") > F.col("_row.a"), F.lit(False)).alias("hit"))


def precedence_merge(layers: Sequence[DataFrame], by: str = "campaign") -> DataFrame:
    """Intervals of several layers, first ones first: a later layer's interval stays only if it strictly overlaps none kept before."""
    kept = layers[0]
    for layer in layers[1:]:
        kept = kept.unionByName(overlaps(layer, kept, by).filter(~F.col("hit")).drop("hit"))
    return kept


def pinned_merge(first: DataFrame, second: DataFrame, third: DataFrame, adjacent: int, by: str = "campaign") -> DataFrame:
    """All intervals (by, layer, a, b and the like) of three layers with their `verdict`: kept, consumed or dropped.

    Whatever overlaps the first layer is consumed.  The second layer has to be pinned by
    the rest of the third: an interval that overlaps one of it stays, so does one at whose
    end, less than `adjacent` away, one of the third begins, and all others are dropped.
    The third layer's intervals that pin one are consumed, the others stay.
    """

    def free(rows: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
        judged = cut(overlaps(rows, taken, by))  # each is read several times
        return judged.filter(~F.col("hit")).drop("hit"), judged.filter("hit").drop("hit")

    def as_row(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        return rows.select(by, F.struct(*rows.columns).alias("row"), low.alias("a"), high.alias("b"))

    around_end, begin = (F.col("b") - adjacent, F.col("b") + adjacent), (F.col("a"), F.col("a"))
    second, gone2 = free(second, first)
    third, gone3 = free(third, first)
    loose, pinned = free(second, third)
    judged = cut(overlaps(as_row(loose, *around_end), as_row(third, *begin), by))
    touching, dropped = judged.filter("hit").select("row.*"), judged.filter(~F.col("hit")).select("row.*")
    rest, over = free(third, pinned)
    begun = overlaps(as_row(rest, *begin), as_row(touching, *around_end), by)
    parts = [(first, "kept"), (pinned, "kept"), (touching, "kept"), (begun.filter(~F.col("hit")).select("row.*"), "kept"), (dropped, "dropped")]
    parts += [(gone2, "consumed"), (gone3, "consumed"), (over, "consumed"), (begun.filter("hit").select("row.*"), "consumed")]
    found = None
    for rows, verdict in parts:
        rows = rows.withColumn("verdict", F.lit(verdict))
        found = rows if found is None else found.unionByName(rows)
    return found


def require_dropped(merged: DataFrame, expected: DataFrame) -> DataFrame:
    """The kept rows of `pinned_merge`, if what it dropped is `expected` (some of its columns), else an error."""
    dropped = merged.filter("verdict = 'dropped'").select(expected.columns)
    odd = dropped.exceptAll(expected).unionByName(expected.exceptAll(dropped)).limit(5).collect()
    if odd:
        raise ValueError(f"unexpected or missing among the dropped intervals: {[tuple(r) for r in odd]}")
    return merged.filter("verdict = 'kept'").drop("verdict")


def settled(events: DataFrame, windows: DataFrame, by: str = "campaign") -> DataFrame:
    """Moves each event's `t` into the nearest of two sessions: the one that began last at or before it, and the next one.

    Of two edges equally near the earlier counts; an event of a group without sessions
    is left out.  Sessions meet events in one pass in order of time, each with the one
    after it, so nothing is joined by inequality.
    """
    columns = events.columns
    order = Window.partitionBy(by).orderBy("a", "b")  # the calendar bounds a campaign's sessions
    after = F.struct(F.lead("a").over(order).alias("a"), F.lead("b").over(order).alias("b"))
    starts = windows.select(by, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    firsts = starts.groupBy(by).agg(F.min(F.struct("a", "b")).alias("next")).select(by, F.lit(-(1 << 61)).alias("t"), F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")).alias("own"), "next")
    edges = starts.select(by, F.col("a").alias("t"), F.struct("a", "b").alias("own"), after.alias("next")).unionByName(firsts)
    edges = edges.select(F.col(by).alias("_by"), F.col("t").alias("_at"), F.lit(0).alias("_kind"), F.struct("own", "next").alias("_s"), F.lit(None).cast(events.select(F.struct(*columns).alias("r")).schema["r"].dataType).alias("_row"))
    asked = events.select(F.col(by).alias("_by"), F.col("t").cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(edges.schema["_s"].dataType).alias("_s"), F.struct(*columns).alias("_row"))
    both = bucketed(edges.unionByName(asked), "_at")
    found = carried(both, ["_by"], F.col("_s"), [F.col("_at"), F.col("_kind")])
    upto = Window.partitionBy("_by", BUCKET).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(upto), F.col("_carried"))).filter("_kind = 1 AND _s IS NOT NULL")
    t = F.col("_at")
    here = F.least(t, F.col("_s.own.b"))
    there = F.col("_s.next.a")
    moved = F.when(F.col("_s.own.b").isNull(), there).when(there - t < t - here, there).otherwise(here)
    return found.select(moved.alias("_moved"), "_row.*").withColumn("t", F.col("_moved")).drop("_moved")


def forward_fill(rows: DataFrame, column: str, by: Sequence[str], order: Sequence[str], unit: int = BUCKET_US) -> DataFrame:
    """Replaces nulls of `column` by the last value before in the group; the first of `order` is a number, dealt to buckets of `unit`."""
    window = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = carried(bucketed(rows, order[0], unit), by, F.col(column), [F.col(c) for c in order])
    return filled.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(window), F.col("_carried"))).drop("_carried", BUCKET)
