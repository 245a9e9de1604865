"""Scans of published text tables: delimited regions, regular expressions and fixed-width lines."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header, with an explicit schema; a byte-order mark before the header does no harm, since the columns go by place."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="FAILFAST")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0 within the file) and line, whatever the splits that a file is read in.

    A split begins at a known byte and its lines come in order; a line's number is its
    place there and the number of lines of the file's earlier splits.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("path", "_block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("_block")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_at")) - 1
    joined = rows.join(blocks.select("path", "_block", before.alias("_before")), ["path", "_block"])
    return joined.select("path", (place + F.col("_before")).cast("bigint").alias("line_no"), "line")


def table_cells(lines: DataFrame, part: str, order: str, begin: str, end: str, row: str) -> DataFrame:
    """Adds `cells` to the lines between a `begin` and an `end` line of their part that look like `row`.

    Cells are split at unescaped &; comments from an unescaped % on, the row end and
    dollar signs are taken off.
    """
    mark = F.when(F.col("line").rlike(begin), 1).when(F.col("line").rlike(end), 0)
    window = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_inside", F.last(mark, ignorenulls=True).over(window)).filter(F.col("line").rlike(row) & (F.col("_inside") == 1))
    bare = F.regexp_replace(F.regexp_replace("line", r"(?<!\\)%.*$", ""), r"\\\\\s*$", "")
    cells = F.transform(F.split(bare, r"(?<!\\)&"), lambda c: F.trim(F.regexp_replace(c, r"\$", "")))
    return rows.withColumn("cells", cells).drop("_inside")


def regex_rows(lines: DataFrame, pattern: str, columns: Mapping[str, str]) -> DataFrame:
    """One row for each matching line, its groups cast to the given types."""
    groups = [F.regexp_extract("line", pattern, i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())]
    return lines.filter(F.col("line").rlike(pattern)).select(*groups)


def byte_layout(header: Sequence[str]) -> list[tuple[str, int, int]]:
    """(name, first byte, last byte), counted from one, of a byte-by-byte description."""
    found = (re.match(r"\s*(\d+)\s*-\s*(\d+)\s+\S+\s+\S+\s+(\S+)", line) for line in header)
    return [(m[3], int(m[1]), int(m[2])) for m in found if m]


def fixed_width_rows(lines: DataFrame, layout: Sequence[tuple[str, int, int]], columns: Mapping[str, str]) -> DataFrame:
    return lines.select(*[F.trim(F.substring("line", first, last - first + 1)).cast(columns[name]).alias(name) for name, first, last in layout])


def manifest_check(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Counts by `key` against `expected` (key, expected); a null expectation isn't checked."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    joined = expected.join(counts, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return joined.withColumn("conforms", F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(True)))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file under `path`."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
