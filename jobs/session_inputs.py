"""Incremental job: takes newly arrived event files and rebuilds the merged inputs of the sessions that they touch.

    python -m jobs.session_inputs EVENTS OUT CHECKPOINT [--config FILE]

A file stream with a checkpoint reads each file of EVENTS once, whenever it arrives,
and keeps its events under OUT/arrived by campaign, day and batch.  Then the days
with anything new are read whole, their events inside the day's session are merged
if less than `gap_us` apart, and OUT/inputs has these partitions (campaign, session)
overwritten.  A batch that is run again overwrites what it wrote, so a failure at
any point is mended by running the job again, and a run without new files changes
nothing.  An event_id that arrives on its day again replaces what came before.
Events without a campaign or time, and those outside all sessions, stay in
OUT/arrived alone.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.timeaxis import DAY_US
from tidewheel.operators.events import assign, latest_by_key, merge_gaps
from tidewheel.plans import frames

log = logging.getLogger("jobs.session_inputs")
CONFIG = Path(__file__).with_suffix(".json")
ARRIVED = "station bigint, event_id bigint, user_id bigint, t bigint, w double, campaign string, session bigint, batch bigint"
INPUTS = "grp bigint, event_id bigint, t bigint, w double, n_merged bigint, campaign string, session bigint"
UNIT = ["campaign", "session"]


def _overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that `rows` has and leaves all others; a file a session, more for a large one."""
    rows.hint("rebalance", *UNIT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_inputs(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(INPUTS).parquet(f"{out}/inputs")


def _take(batch: DataFrame, number: int, out: str, gap_us: int) -> tuple[int, int]:
    """One batch: stores its events and rebuilds the sessions of their days; the rows of both, as read back."""
    spark = batch.sparkSession
    day = F.floor(F.col("t") / DAY_US)  # a session is named by its day
    _overwrite(frames.timed(batch).withColumns({"session": day, "batch": F.lit(number).cast("bigint")}), f"{out}/arrived", [*UNIT, "batch"])
    arrived = spark.read.schema(ARRIVED).parquet(f"{out}/arrived").filter(F.col("batch") <= number)
    touched = arrived.filter(F.col("batch") == number).select(*UNIT).distinct()
    days = latest_by_key(arrived.join(touched, UNIT, "left_semi"), [*UNIT, "event_id"], ["batch", "t", "w"]).drop("session")
    inside = assign(days, frames.sessions(touched.select("campaign").distinct()))
    _overwrite(merge_gaps(inside, UNIT, gap_us), f"{out}/inputs", UNIT)
    return arrived.filter(F.col("batch") == number).count(), read_inputs(spark, out).join(touched, UNIT, "left_semi").count()


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new in `source` (a Parquet file, or a folder of them that grows) and ends: events read and rows rebuilt."""
    settings = json.loads(CONFIG.read_text()) | (config or {})
    done = {"read": 0, "rebuilt": 0}

    def take(batch: DataFrame, number: int) -> None:
        read, rebuilt = _take(batch, number, out, settings["gap_us"])
        done["read"] += read
        done["rebuilt"] += rebuilt
        log.info("batch %d: read and stored %d events, rebuilt %d rows of their sessions in %s", number, read, rebuilt, out)

    schema = spark.read.parquet(source).schema
    pattern = f"{source[:-1]}[{source[-1]}]"  # a stream takes one file by a pattern only
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(pattern)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %(read)d new events, rebuilt %(rebuilt)d rows", done)
    return done


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("events", "out", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("session_inputs").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.events.rstrip("/"), args.out, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
