"""Event merging on a stream: session windows with a gap, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_stream(events: DataFrame, gap_us: int = 100_000, lateness: str = "10 minutes") -> DataFrame:
    """campaign, first, last, n_merged and the brightest event of each run of events less than `gap_us` apart.

    `events` has campaign, ts (timestamp), event_id and w, streaming or not.  State
    holds one row for each open run; a run closes when the watermark passes its end.
    Of equally bright events the first stands for the run.  Spark joins sessions that
    touch, so the window gap is one microsecond less.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    brightest = F.max(F.struct("w", (-F.unix_micros("ts")).alias("nt"), (-F.col("event_id")).alias("ni")))
    merged = rows.groupBy("campaign", F.session_window("ts", f"{gap_us - 1} microseconds")).agg(brightest.alias("m"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n_merged"))
    return merged.select("campaign", (-F.col("m.ni")).alias("event_id"), F.col("m.w").alias("w"), "first", "last", "n_merged")
