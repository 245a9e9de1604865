"""Tables inside texts: a list of rules finds regions of lines, splits their rows into cells and checks their sizes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE = -1


@dataclass(frozen=True)
class Rule:
    """What a table looks like, in regular expressions on single lines.

    With `begin`, a region is what follows a line like it up to one like `end` (or the
    next `begin`); without, each run of consecutive lines like `row` is one.  Cells are
    what `cells` splits a row into, else the groups of `row`.  `rows` is the number of
    rows that each region has to have, where it is known.
    """

    name: str
    row: str
    cells: str | None = None
    begin: str | None = None
    end: str | None = None
    rows: int | None = None


def numbered_lines(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 0) and line of each text; a null text has no lines.  Nothing is shuffled."""
    return texts.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _hit(rule: Rule) -> Column:
    """What a line is to a rule, or null: kind b(egin), e(nd) or r(ow)."""
    line = F.col("line")
    looks = [(c, p) for c, p in (("b", rule.begin), ("e", rule.end), ("r", rule.row)) if p is not None]
    kind = F.coalesce(*[F.when(line.rlike(p), F.lit(c)) for c, p in looks])
    groups = [F.regexp_extract(line, rule.row, i + 1) for i in range(re.compile(rule.row).groups)] or [line]
    cells = F.split(line, rule.cells) if rule.cells is not None else F.array(*groups)
    return F.when(kind.isNotNull(), F.struct(F.lit(rule.name).alias("rule"), kind.alias("kind"), F.when(kind == "r", cells).alias("cells"), F.lit(rule.begin is not None).alias("bounded"), F.lit(rule.rows).cast("bigint").alias("expected")))


def region_rows(lines: DataFrame, rules: Sequence[Rule], keys: Sequence[str], strict: bool = False) -> DataFrame:
    """The rows of all regions: keys, rule, region (the line that begins it), line_no, cells, n_rows (of the region), conforms.

    A region conforms if all its rows have equally many cells and it has as many rows as
    its rule says; with `strict` one that doesn't fails the plan that reads it.  Only
    lines that a rule knows are shuffled, by text and rule.  Repeated texts under equal
    keys have their rows repeated in the same regions.
    """
    hits = F.filter(F.array(*[_hit(r) for r in rules]), lambda h: h.isNotNull())
    marked = lines.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), F.explode(hits).alias("_h")).select(*keys, "line_no", "_h.*")
    order = Window.partitionBy(*keys, "rule").orderBy("line_no")
    apart = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(True))
    opens = F.when(F.col("bounded"), F.when(F.col("kind") == "b", F.col("line_no")).when(F.col("kind") == "e", OUTSIDE)).otherwise(F.when(apart, F.col("line_no")))
    marked = marked.withColumn("_opens", opens)
    region = F.last("_opens", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("region", region).filter(f"kind = 'r' AND region > {OUTSIDE}")
    whole = Window.partitionBy(*keys, "rule", "region")
    size = F.size("cells")
    rows = rows.withColumns({"n_rows": F.count("*").over(whole), "_even": F.min(size).over(whole) == F.max(size).over(whole)})
    conforms = F.col("_even") & F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(True))
    if strict:
        where = F.concat_ws(" ", F.lit("region of rule"), "rule", F.lit("at line"), F.col("region").cast("string"), F.lit("does not conform"))
        conforms = F.when(conforms, F.lit(True)).otherwise(F.raise_error(where).cast("boolean"))
    return rows.select(*keys, "rule", "region", "line_no", "cells", "n_rows", conforms.alias("conforms"))
