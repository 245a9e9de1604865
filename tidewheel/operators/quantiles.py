"""Exact percentiles of groups of any size, by histograms that are refined around the wanted ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.sources.shared import cut

STEPS = 4096  # of a histogram between the least and the greatest value of a bin
LEAF = 4096  # values of a bin that are sorted in one row


def _same(left: DataFrame, right: DataFrame, by: Sequence[str], *more: Column) -> Column:
    found = F.lit(True)
    for c in [left[c].eqNullSafe(right[c]) for c in by] + list(more):
        found = found & c
    return found


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """by, n and one column for each of `shares`: the exact percentile, linear between the two nearest values.

    A bin holds the values of a group between two bounds and its histogram has the
    number, least and greatest value of each step, so the next bin around a rank is
    bounded by values that exist and at least two of them part; a bin of few values
    is sorted, one of equal values is done.  Each round is one map-side-combined pass,
    and no task holds a group.  Nulls don't count; a group without values has none.
    Values have to be finite, others fail.
    """
    number = F.col(value).cast("double")
    finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.raise_error(F.lit(f"{value} is not finite")).cast("double")).otherwise(number)
    values = rows.select(*by, finite.alias("_v")).filter("_v is not null")
    whole = cut(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(x), F.ceil(x)) for x in at.values()]))
    wanted = cut(whole.select(*by, F.explode(ranks).alias("_rank"), "n", "_lo", "_hi").withColumn("_skip", F.col("_rank")))
    columns = [*by, "_rank", "n", "_lo", "_hi", "_skip"]
    while not (todo := wanted.filter("_lo < _hi")).isEmpty():
        bins = todo.select(*[F.col(c).alias(f"b_{i}") for i, c in enumerate(by)], F.col("n").alias("_n"), "_lo", "_hi").distinct()
        inside = F.lit(True)
        for i, c in enumerate(by):
            inside = inside & values[c].eqNullSafe(bins[f"b_{i}"])
        held = values.join(bins, inside & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bin_key = [*by, "_lo", "_hi"]
        step = F.floor((F.col("_v") * 0.5 - F.col("_lo") * 0.5) / (F.col("_hi") * 0.5 - F.col("_lo") * 0.5) * (STEPS - 1))
        steps = held.filter(F.col("_n") > LEAF).groupBy(*bin_key, step.alias("_step")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_c").over(Window.partitionBy(*bin_key).orderBy("_step"))  # no more than STEPS rows
        steps = steps.withColumn("_before", upto - F.col("_c"))
        leaves = held.filter(F.col("_n") <= LEAF).groupBy(*bin_key).agg(F.array_sort(F.collect_list("_v")).alias("_sorted"))
        part = todo.alias("t").join(steps.alias("s"), _same(todo, steps, bin_key, F.col("_skip") >= F.col("_before"), F.col("_skip") < F.col("_before") + F.col("_c")))
        part = part.select(*[F.col(f"t.{c}") for c in [*by, "_rank"]], F.col("_c").alias("n"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_skip") - F.col("_before")).alias("_skip"))
        last = todo.alias("t").join(leaves.alias("s"), _same(todo, leaves, bin_key))
        exact = F.element_at("_sorted", (F.col("_skip") + 1).cast("int"))
        last = last.select(*[F.col(f"t.{c}") for c in [*by, "_rank", "n"]], exact.alias("_lo"), exact.alias("_hi"), "_skip")
        wanted = cut(wanted.filter("_lo = _hi").select(columns).unionByName(part.select(columns)).unionByName(last.select(columns)))
    found = wanted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_values"))
    joined = whole.alias("w").join(found.alias("f"), _same(whole, found, by)).select(*[F.col(f"w.{c}") for c in [*by, "n"]], "_values")

    def percentile(x: Column) -> Column:
        low, high = F.element_at("_values", F.floor(x)), F.element_at("_values", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    return joined.select(*by, "n", *[percentile(x).alias(name) for name, x in at.items()])
