"""Sinks: counted CSV, checked exports, an append-only unit checkpoint, JSON results and an environment record."""

from __future__ import annotations

import platform
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.events import latest_by_key


def write_csv(rows: DataFrame, path: str) -> int:
    """Writes a CSV with a header and returns how many rows it holds, as read back."""
    rows.write.mode("overwrite").csv(path, header=True)
    return rows.sparkSession.read.schema(rows.schema).csv(path, header=True).count()


def export_inputs(events: DataFrame, windows: DataFrame, path: str) -> DataFrame:
    """Writes events and windows as CSV with times to 1e-12 days, checks that they read back equal, and returns the manifest.

    `events` has campaign, event_id, t and `windows` campaign, a, b (days).  The
    manifest has, for each campaign, the numbers of both and a SHA-256 of its events in
    order of time (days are hashed first, then their hashes); it is written beside them as JSON.
    """
    spark = events.sparkSession
    e = events.select("campaign", F.col("event_id").cast("string").alias("event_id"), F.format_string("%.12f", "t").alias("t"))
    w = windows.select("campaign", F.format_string("%.12f", "a").alias("a"), F.format_string("%.12f", "b").alias("b"))
    for rows, name in ((e, "events"), (w, "windows")):
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)
        back = spark.read.schema(rows.schema).csv(f"{path}/{name}", header=True)
        if not (rows.exceptAll(back).isEmpty() and back.exceptAll(rows).isEmpty()):
            raise ValueError(f"{name} read back differently from {path}")
    manifest = _manifest(e, w)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def _manifest(events: DataFrame, windows: DataFrame) -> DataFrame:
    """campaign, n_events, events_hash and n_sessions of an export's own rows (times as text)."""
    t = F.col("t").cast("double")
    days = events.groupBy("campaign", F.floor(t).alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(t.alias("at"), "event_id", "t"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws(",", r["event_id"], r["t"])), ";")
    days = days.select("campaign", "day", "n", F.sha2(text.cast("binary"), 256).alias("h"))
    whole = days.groupBy("campaign").agg(F.sum("n").alias("n_events"), F.array_sort(F.collect_list(F.struct("day", "h"))).alias("days"))
    hashed = whole.select("campaign", "n_events", F.sha2(F.array_join("days.h", "").cast("binary"), 256).alias("events_hash"))
    return hashed.join(windows.groupBy("campaign").agg(F.count("*").alias("n_sessions")), "campaign", "full")


def read_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and windows of an export, checked against its JSON manifest: numbers and hashes have to agree."""
    e = spark.read.schema("campaign string, event_id string, t string").csv(f"{path}/events", header=True)
    w = spark.read.schema("campaign string, a string, b string").csv(f"{path}/windows", header=True)
    found = _manifest(e, w)
    recorded = spark.read.schema(found.schema).json(f"{path}/manifest")
    bad = found.exceptAll(recorded).unionByName(recorded.exceptAll(found)).select("campaign").distinct().orderBy("campaign").limit(5).collect()
    if bad:
        raise ValueError("the manifest disagrees on " + ", ".join(str(r["campaign"]) for r in bad))
    return e.withColumn("t", F.col("t").cast("double")), w.withColumns({c: F.col(c).cast("double") for c in "ab"})


class UnitStore:
    """Append-only results of units of work: `append` adds, the last write of a key wins, `pending` is what has none."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)

    def append(self, results: DataFrame) -> None:
        """Adds a batch under a name of its own; a batch is visible whole or not at all, and of two written at once one wins whole."""
        stamp = {"written": F.lit(self._next()).cast("bigint"), "batch": F.lit(uuid.uuid4().hex)}
        results.withColumns(stamp).write.mode("append").parquet(f"{self.path}/batches")

    def _next(self) -> int:
        rows = self.rows()
        return 0 if rows is None else (rows.agg(F.max("written")).first()[0] or 0) + 1

    def rows(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(f"{self.schema}, written bigint, batch string").parquet(f"{self.path}/batches")

    def done(self) -> DataFrame:
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        return latest_by_key(rows, self.key, ["written", "batch"]).drop("written", "batch")

    def pending(self, units: DataFrame) -> DataFrame:
        return units.join(self.done().select(self.key), self.key, "left_anti")


def write_json(rows: DataFrame, path: str) -> None:
    """Replaces the JSON lines at `path`."""
    rows.write.mode("overwrite").json(path)


def read_artifacts(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Whole-file JSON artifacts (pins, alias sets, fits): one row a file with its `path`; a file that isn't JSON fails."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True, mode="FAILFAST")
    return rows.withColumn("path", F.col("_metadata.file_path"))


def require_last_line(spark: SparkSession, path: str, text: str = "ALL PASS") -> None:
    """Fails unless the last line of the file that isn't blank contains `text`: the gate before a study."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"([^\n]*)\s*$", 1).alias("last")).collect()
    if len(whole) != 1 or text not in whole[0]["last"]:
        raise ValueError(f"{path} does not end in {text!r}")


def read_summaries(spark: SparkSession, pattern: str, schema: str, key: Sequence[str]) -> DataFrame:
    """JSON-line summaries of many files; of one key the last line of the file that sorts last wins.

    Lines of a split of a file come in order, and splits are ordered by where they begin.
    """
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    rows = spark.read.schema(schema).json(pattern).withColumns(place)
    return latest_by_key(rows, key, list(place)).drop(*place)


def replace_campaigns(rows: DataFrame, path: str) -> DataFrame:
    """Overwrites the partitions of the campaigns that `rows` has and leaves all others; returns the whole table as read back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("campaign").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions and settings that a result depends on."""
    import numpy
    import pyarrow

    return {
        "run": uuid.uuid4().hex,
        "python": platform.python_version(),
        "spark": spark.version,
        "numpy": numpy.__version__,
        "pyarrow": pyarrow.__version__,
        "timezone": spark.conf.get("spark.sql.session.timeZone"),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
