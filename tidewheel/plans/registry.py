"""The registered queries of the event-timing engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.plans import aliasset, models, phases, relational, reports

MODULES = (relational, phases, models, aliasset, reports)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lambda_stat"](spark, sf_dir)
