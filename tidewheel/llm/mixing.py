"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Documents hash to 60 bits of their doc_id, and rows of one doc_id (null ones too) to
60 bits of their other columns below that.  A source's budget beyond whole copies of
it is a prefix of its hash range: sizes are summed by source and the top 12 bits, the
bucket in which the budget ends is found, and only that bucket is summed again by its
next 12 bits, until it holds rows that are equal.  Then a filter on the threshold
takes the documents, and of equal rows at the threshold as many as fit; nothing is
sorted but each source's few thousand sums.  A larger budget has a higher threshold,
so mixes of growing budgets nest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.session import broadcast_if_small, cut

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
HASH_BITS, LEVEL_BITS = 60, 12
SOURCES_A_BROADCAST = 20_000
ROWS_A_RUN = 100_000  # equal rows are dealt out in runs
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"

_KEY = ["no_source", "named"]
_ORDER = ["hash", "row_hash"]


def _keyed(docs: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """`docs` with size, the hashes of doc_id and of the row (text and the columns `others`) and the source as a join key without nulls."""
    source = F.col("source").cast("string")
    # each word and the white space after it become one letter; lists of the words themselves would fill the heap
    marks = F.translate(F.regexp_replace(F.col("text").cast("string"), WORD, "w"), " \t\n\x0b\f\r", "")
    size = F.coalesce(F.length(marks), F.lit(0)).cast("bigint")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")
    rest = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))] if others else []
    row = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string"), *rest), 64 - HASH_BITS)
    return docs.withColumns({"size": size, "hash": hashed, "row_hash": row, "no_source": source.isNull(), "named": F.coalesce(source, F.lit(""))})


def _targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds the target of each source: its weight's part of the budget, at most `most` times its size.

    Budget that a source can't take is shared out again by weight, until no source
    is above its limit: with the sources ordered by limit over weight, the first
    whose part of the rest fits its limit sets the rate for it and all after it.
    """
    by_name = Window.orderBy("no_source", "named")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    rows = sources.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(most), "total": F.sum("source_size").over(everything)})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "named")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.lit(share) * F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumns({"place": F.row_number().over(order), "rate": rate})
    fits = F.when(F.col("rate") <= F.col("limit") / F.col("weight"), F.struct("place", "rate"))
    rows = rows.withColumn("first_fit", F.min(fits).over(everything))
    target = F.when(F.col("place") >= F.col("first_fit.place"), F.col("weight") * F.col("first_fit.rate")).otherwise(F.col("limit"))
    return rows.select(*_KEY, "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan(sizes: DataFrame, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of `docs`: size, target, whole copies `base`, and the hashes up to which documents get one copy more.

    `sizes` has the key, the hashes and the size of every document with words.  Rows
    at the threshold itself are equal rows; `more` of their `ties` get the copy.
    """
    source = F.col("source").cast("string")
    named = docs.select(source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("named"), F.lit(0).cast("bigint").alias("size"))
    sources = cut(sizes.select(*_KEY, "size").union(named).groupBy(*_KEY).agg(F.sum("size").alias("source_size")))
    n = sources.count()
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = _targets(sources, weights, share, most).withColumn("base", base)
    targets = cut(targets.withColumn("need", F.col("target") - F.col("base") * F.col("source_size")), rows=n)
    state = targets.select(*_KEY, "need", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("ties"), *[F.lit(None).cast("bigint").alias(f"at_{h}") for h in _ORDER], F.lit(False).alias("done"))
    inside = sizes
    last = HASH_BITS // LEVEL_BITS
    for level in range(1, 2 * last + 1):
        column, rest = _ORDER[(level - 1) // last], HASH_BITS - ((level - 1) % last + 1) * LEVEL_BITS
        open_ = broadcast_if_small(state.filter("not done").select(*_KEY, "need", "below"), SOURCES_A_BROADCAST)
        inside = inside.join(open_, _KEY).select(*_KEY, *_ORDER, "size", "need", "below", F.shiftright(column, rest).alias("at"))
        key = F.struct(*_ORDER)
        sums = inside.groupBy(*_KEY, "need", "below", "at").agg(F.sum("size").alias("size"), F.count("*").alias("ties"), F.min(key).alias("least"), F.max(key).alias("most"))
        upward = Window.partitionBy(*_KEY).orderBy("at")
        sums = sums.withColumn("upto", F.col("below") + F.sum("size").over(upward))
        crossing = sums.filter("upto > need").groupBy(*_KEY).agg(F.min(F.struct("at", "upto", "size", "ties", "least", "most")).alias("c")).select(*_KEY, "c.*")
        one = F.col("least") == F.col("most")  # the bucket's rows are equal
        found = crossing.select(*_KEY, F.col("at").alias("c_prefix"), (F.col("upto") - F.col("size")).alias("c_below"), F.col("size").alias("c_size"), F.col("ties").alias("c_ties"), *[F.col(f"most.{h}").alias(f"c_{h}") for h in _ORDER], (one if level < 2 * last else F.lit(True)).alias("c_one"), F.lit(True).alias("crosses"))
        now, settled = ~F.col("done") & F.col("crosses").isNotNull(), F.col("done") | F.col("crosses").isNull() | F.col("c_one")
        # a source whose budget ends in no bucket takes all its documents
        everything = F.lit((1 << HASH_BITS) - 1)
        state = state.join(found, _KEY, "left").select(
            *_KEY,
            "need",
            F.when(now, F.col("c_prefix")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(now, F.col("c_below")).otherwise(F.col("below")).alias("below"),
            F.when(now, F.col("c_size")).otherwise(F.col("size")).alias("size"),
            F.when(now, F.col("c_ties")).otherwise(F.col("ties")).alias("ties"),
            *[F.when(F.col("done"), F.col(f"at_{h}")).when(now, F.col(f"c_{h}")).otherwise(everything).alias(f"at_{h}") for h in _ORDER],
            settled.alias("done"),
        )
        state = cut(state, rows=n)
        if state.filter("not done").isEmpty():
            break
        crossed = broadcast_if_small(state.filter("not done").select(*_KEY, F.col("prefix").alias("at")), SOURCES_A_BROADCAST)
        inside = cut(inside.select(*_KEY, *_ORDER, "size", "at").join(crossed, [*_KEY, "at"]).select(*_KEY, *_ORDER, "size"))
    each = F.col("size") / F.col("ties")
    more = F.least(F.col("ties"), F.greatest(F.lit(0), F.ceil((F.col("need") - F.col("below")) / each - 0.5)))  # as near as whole documents come; ties: below
    state = state.select(*_KEY, *[f"at_{h}" for h in _ORDER], F.coalesce(more, F.lit(0)).cast("bigint").alias("more"), F.coalesce("ties", F.lit(0)).alias("ties"))
    return cut(targets.join(state, _KEY).select(*_KEY, "source_size", "target", "base", *[f"at_{h}" for h in _ORDER], "more", "ties"), rows=n)


def _dealt(rows: DataFrame, sources: DataFrame, out: Sequence[str]) -> DataFrame:
    """`rows` joined with the plan `sources`, as the columns `out` and their `copies`.

    Rows below their source's threshold get one copy more than `base`.  Where only
    some of the equal rows at a threshold do, these are counted and dealt out anew.
    """
    rows = rows.join(broadcast_if_small(sources, SOURCES_A_BROADCAST), _KEY)
    key, at = F.struct(*_ORDER), F.struct(*[F.col(f"at_{h}").alias(h) for h in _ORDER])
    split = (key == at) & (F.col("more") > 0) & (F.col("more") < F.col("ties")) & (F.col("size") > 0)
    plain = rows.filter(~split).select(*out, (F.col("base") + ((key < at) | ((key == at) & (F.col("more") > 0))).cast("bigint")).alias("copies"))
    if sources.filter("more > 0 and more < ties").isEmpty():
        return plain
    some = rows.filter(split).groupBy(*_KEY).agg(F.first(F.struct(*out)).alias("row"), F.first("base").alias("base"), F.first("more").alias("more"), F.count("*").alias("n"))
    parts = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("times")), F.struct(F.col("base").alias("copies"), (F.col("n") - F.col("more")).alias("times")))
    some = some.select("row", F.explode(parts).alias("part")).filter("part.times > 0").select("row", "part.copies", "part.times")
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("times") - 1, F.lit(ROWS_A_RUN))))
    some = some.withColumn("run", runs).repartition("run")
    some = some.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(ROWS_A_RUN), F.col("times") - F.col("run") * ROWS_A_RUN))))
    return plain.unionByName(some.select(*[F.col(f"row.`{c}`").alias(c) for c in out], "copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of `docs` (doc_id, text, source; others are not read).

    size counts words; weights go round the sources by code point, null last; the
    budget is `share` times all sizes, and a source takes at most `most` times its
    size.  taken is size times the copies that the mix takes; a source's taken words
    are as near its target as whole documents in hash order come (ties: below).
    Null and empty texts have size and taken 0.  Rows with equal doc_id, and those
    with a null one, follow each other by their texts; of equal rows as many are
    taken once more as fit.  Reruns agree.  No rows give no rows.
    """
    keyed = cut(_keyed(docs.select("doc_id", "text", "source")).select("doc_id", "source", *_KEY, *_ORDER, "size"))
    sources = plan(keyed.filter("size > 0").select(*_KEY, *_ORDER, "size"), keyed, weights, share, most)
    rows = _dealt(keyed, sources, ["doc_id", "size", "source_size", "target"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of `docs` that the mix takes at least once, with their number of `copies` (a column of that name is replaced).

    Rows of one doc_id go by their text and other columns; those may be of any type
    that has a JSON form.
    """
    kept = [c for c in docs.columns if c != "copies"]
    others = [c for c in kept if c not in ("doc_id", "text", "source")]
    hashed = _keyed(docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(others)]), [f"__{i}" for i in range(len(others))])
    sizes = cut(hashed.filter("size > 0").select(*_KEY, *_ORDER, "size"))
    rows = _dealt(hashed, plan(sizes, docs, weights, share, most), ["doc_id", "text", "source", *[f"__{i}" for i in range(len(others))]]).filter("copies > 0")
    renamed = {c: F.col(c) for c in ("doc_id", "text", "source")} | {c: F.col(f"__{i}") for i, c in enumerate(others)}
    return rows.select(*[renamed[c].alias(c) for c in kept], "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight,
         source_size * 2.0::DOUBLE AS lim, sum(source_size) OVER () AS total FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place,
         (1.5::DOUBLE * total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w
), f AS (
  SELECT min(place) AS place, arg_min(rate, place) AS rate FROM r WHERE rate <= lim / weight
), t AS (
  SELECT r.source, r.source_size, CASE WHEN r.place >= f.place THEN r.weight * f.rate ELSE r.lim END AS target FROM r LEFT JOIN f ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t
), n AS (SELECT *, target - base * source_size AS need FROM b
), g AS (
  SELECT source, h, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, h
), c AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM g
), k AS (
  SELECT c.source, c.h, (c.upto <= n.need OR (c.upto - c.size <= n.need AND c.upto - n.need < n.need - (c.upto - c.size))) AS more
  FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source
)
SELECT d.doc_id, d.size, n.source_size, coalesce(n.target, 0) AS target,
       CAST(d.size * (n.base + CASE WHEN k.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
