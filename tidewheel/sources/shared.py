"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, prefix: str) -> str:
    """A new name under spark.checkpoint.dir; only where that is unset on a local master under a temporary folder, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{prefix}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """Computes `rows` once into a table in the shared folder, which goes when the driver ends, and reads it from there: loops stay short plans and survive lost executors."""
    spark = rows.sparkSession
    path = new_folder(spark, "cut")
    rows.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(rows.schema).parquet(path)
