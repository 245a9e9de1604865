"""Batch job: extracts the tables inside whole texts by a list of rules, with row checks and the texts' SHA-256.

    python -m jobs.published_tables DOCUMENTS OUT [--config FILE]

OUT/rows has one row for each table row, partitioned by rule, with the hash of the
text it comes from; OUT/tally has, by rule and source, the numbers of texts, regions,
rows and regions that don't conform.  Both are replaced whole, so running it again
gives the same.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.regions import Rule, numbered_lines, region_rows

log = logging.getLogger("jobs.published_tables")
CONFIG = Path(__file__).with_suffix(".json")
ROWS = "doc_id bigint, source string, sha256 string, region bigint, line_no bigint, n_rows bigint, conforms boolean, cells array<string>, rule string"
KEYS = ["doc_id", "source", "sha256"]


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{out}/rows")


def tally(rows: DataFrame) -> DataFrame:
    """rule, source, n_texts, n_regions, n_rows, n_not_conforming (regions), in two map-side-combined steps."""
    regions = rows.groupBy("rule", *KEYS, "region").agg(F.count("*").alias("n"), F.min("conforms").alias("conforms"))
    texts = regions.groupBy("rule", *KEYS).agg(F.count("*").alias("regions"), F.sum("n").alias("n"), F.count_if(~F.col("conforms")).alias("odd"))
    return texts.groupBy("rule", "source").agg(F.count("*").alias("n_texts"), F.sum("regions").alias("n_regions"), F.sum("n").alias("n_rows"), F.sum("odd").alias("n_not_conforming"))


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Extracts from all texts of `documents` (doc_id, source, text); the numbers of texts, and of rows and tallies as read back."""
    settings = json.loads(CONFIG.read_text()) | (config or {})
    rules = [Rule(**r) for r in settings["rules"]]
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "text")
    rows = region_rows(numbered_lines(docs, KEYS), rules, KEYS)
    rows = rows.select("doc_id", "source", "sha256", "region", "line_no", "n_rows", "conforms", "cells", "rule")
    rows.write.mode("overwrite").partitionBy("rule").parquet(f"{out}/rows")
    sums = tally(read_rows(spark, out))
    sums.write.mode("overwrite").parquet(f"{out}/tally")
    done = {"texts": docs.count(), "rows": read_rows(spark, out).count(), "tallies": spark.read.schema(sums.schema).parquet(f"{out}/tally").count()}
    log.info("read %d texts of %s; wrote %d rows and %d tallies to %s", done["texts"], documents, done["rows"], done["tallies"], out)
    return done


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out"):
        parser.add_argument(name)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("published_tables").getOrCreate()
    try:
        run(spark, args.documents, args.out, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
