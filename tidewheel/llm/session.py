"""Session helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_A_FILE = 1_000_000  # of a table of a few numbers a row


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset on a local master (tests, one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Computes `df` once into a table in the session's shared folder and reads it from there.

    The table survives lost executors, ends the lineage, and gives later plans its
    true size (a plan over checkpoint() carries the product of all sizes that it was
    joined from).  It is deleted when the driver ends, or before by `drop`.

    `rows`, an upper bound of its rows, says that `df` has rows of a few numbers.
    They are dealt out to files of at most `ROWS_A_FILE` rows, and no fewer files
    than the cluster has cores: else each step of a loop leaves one file for each
    shuffle partition, most of them next to empty.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(max(8, spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    path = f"{_shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _filesystem(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(table: DataFrame | None) -> None:
    """Deletes a table that `cut` made, once no plan that is still to run reads it."""
    for file in table.inputFiles()[:1] if table is not None else ():
        where, files = _filesystem(table.sparkSession, file.rsplit("/", 1)[0])
        files.delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks `df` (already cut) for a broadcast join if it has at most `rows` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
