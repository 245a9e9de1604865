"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are put into size partitions (doubling numbers of shingles).  An item's sketch
is its k hash minima, with k set by its partition so that the search can't miss:
an item of n shingles that lies in a document up to a share t misses at most
m = floor((1 - t) n) of them, so of any k > m of its hashes at least k - m are among
the document's.  (Shingles that many items share come after all others, so that a
template makes no hits unless an item has little else.)  A document probes only the
partitions whose items its own size can hold: partition and minimum are the key of
the join.  A Bloom filter over all minima is asked in the scan's own stage, so the rows
that go on to the join are in proportion to a document's hits and not to its length.  Items that a
document hits often enough are candidates, and exact containment on the shingles
themselves decides, once a document for all of its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.session import broadcast_if_small, cut, drop

SKETCH_ROWS_A_BROADCAST = 500_000
CANDIDATES_A_BROADCAST = 200_000
TEMPLATES_A_BROADCAST = 200_000
TEMPLATE = 64  # items that share a shingle, from which it comes last in a sketch
SHINGLES_A_BLOCK = 4096  # of items that meet a document's shingles at once
BITS_A_MINIMUM, MOST_BITS = 16, 1 << 26  # of the Bloom filter; with more minima it lets more through
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    low = F.translate(text.cast("string"), _UPPER, _UPPER.lower())
    return F.filter(F.split(low, _SPACE), lambda w: w != "")


def _per_shingle(words: Column, k: int, make) -> Column:
    """The distinct make(shingle) of each k-word shingle; a short sequence is one shingle, none has none.

    The words are bound to a lambda variable, so that no optimiser rule can copy the
    splitting of the text into each step.
    """

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: make(F.slice(w, i, k))))

    return F.element_at(F.transform(F.array(words), of), 1)


def _hashes(text: Column, k: int) -> Column:
    return _per_shingle(_words(text), k, F.xxhash64)


def _shingles(text: Column, k: int) -> Column:
    return _per_shingle(_words(text), k, lambda w: F.array_join(w, " "))


def _size_partition(n: Column) -> Column:
    """The least p with n <= 2^p, in whole numbers."""
    return F.when(n > 1, F.length(F.bin((n - 1).cast("bigint")))).otherwise(0)


def _least_held(partition: Column, percent: int) -> Column:
    """The shingles that a document needs for the smallest item of a partition."""
    smallest = F.pow(F.lit(2.0), partition - 1) + 1
    return F.when(partition > 0, F.ceil(smallest * percent / 100)).otherwise(1).cast("int")


def _sketch(item_rows: DataFrame, percent: int) -> DataFrame:
    """(item_id, needed, part, h): the minima of each item and how many of them a document must hit."""
    each = item_rows.select("item_id", "row", F.explode("hashes").alias("h"))
    templates = cut(each.groupBy("h").count().filter(F.col("count") > TEMPLATE).select("h", F.lit(1).alias("late")))
    ordered = each.join(broadcast_if_small(templates, TEMPLATES_A_BROADCAST), "h", "left").select("item_id", "row", F.struct(F.coalesce("late", F.lit(0)).alias("late"), "h").alias("r"))
    ordered = ordered.groupBy("item_id", "row").agg(F.array_sort(F.collect_list("r")).alias("ordered"))
    n, part = F.size("ordered"), _size_partition(F.size("ordered"))
    missed = F.floor(n * (100 - percent) / 100).cast("int")
    most_missed = F.floor(F.pow(F.lit(2.0), part) * (100 - percent) / 100).cast("int")
    k = F.least(n, most_missed + 1)
    minima = ordered.select("item_id", (k - missed).alias("needed"), part.alias("part"), F.explode(F.slice("ordered", F.lit(1), k)).alias("r"))
    sketch = cut(minima.select("item_id", "needed", "part", "r.h"))
    drop(templates)
    return sketch


def _places(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]


def _bloom(sketch: DataFrame, bits: int) -> DataFrame:
    """One row: `bits` bits in an array of numbers of 64, with two bits set for each minimum."""
    place = sketch.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(63).cast("int"))
    some = place.groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(one).alias("word"))
    every = sketch.sparkSession.range(bits // 64).join(some, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word")).alias("w"))
    return cut(every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("words")))


def _may_hold(words: Column, h: Column, bits: int) -> Column:
    def is_set(place: Column) -> Column:
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    first, second = _places(h, bits)
    return is_set(first) & is_set(second)


def _candidates(texts: DataFrame, sketch: DataFrame, minima: int, top: int, words: int, percent: int) -> DataFrame:
    """(doc_id, item_id) where a document hits enough of an item's minima in a partition it can hold."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_A_MINIMUM * minima - 1).bit_length()))
    bloom = _bloom(sketch, bits)
    # one expression makes hashes and their number, so that no rule has them computed twice
    probe = F.transform(F.array(_hashes(F.col("text"), words)), lambda held: F.transform(held, lambda h: F.struct(h.alias("h"), F.size(held).alias("holds"))))
    probes = texts.select("doc_id", F.explode(F.element_at(probe, 1)).alias("probe")).select("doc_id", "probe.h", "probe.holds")
    probes = probes.filter(_may_hold(bloom.scalar(), F.col("h"), bits))
    parts = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda p: _least_held(p, percent) <= F.col("holds"))
    probes = probes.select("doc_id", "h", F.explode(parts).alias("part"))
    hits = probes.join(broadcast_if_small(sketch, SKETCH_ROWS_A_BROADCAST), ["part", "h"])
    hits = hits.groupBy("doc_id", "item_id", "needed").agg(F.count("*").alias("hits")).filter("hits >= needed")
    found = cut(hits.select("doc_id", "item_id").distinct())
    drop(bloom)
    return found


def _blocks(candidates: DataFrame, item_rows: DataFrame) -> DataFrame:
    """(doc_id, items): each document's candidates with their shingles, dealt into blocks of a bounded number of these."""
    sizes = item_rows.select("item_id", F.size("item_shingles").alias("n"))
    number = candidates.join(sizes, "item_id").groupBy("doc_id").agg(F.ceil(F.sum("n") / SHINGLES_A_BLOCK).alias("number"))
    met = candidates.join(number, "doc_id").join(item_rows.select("item_id", "item_shingles"), "item_id")
    met = met.groupBy("doc_id", F.pmod(F.xxhash64("item_id"), "number").alias("block"))
    return cut(met.agg(F.collect_list(F.struct("item_id", "item_shingles")).alias("items")).select("doc_id", "items"))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shared and n_item of each pair where a document holds at least `percent` of an item's shingles.

    Reads doc_id and text of `docs` and item_id and text of `items`; words are runs
    without ASCII white space, A-Z lowered.  A text of fewer than `words` words is
    one shingle, and so is found only in a document of just those words.  Null and
    wordless texts match nothing, rows with a null id have no pair.  Repeated rows
    with one id give one row, with the most shared; no rows give no rows.
    """
    texts = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("string"))
    item_rows = items.filter("item_id is not null").select("item_id", F.xxhash64(F.col("text").cast("string")).alias("row"), _hashes(F.col("text"), words).alias("hashes"), _shingles(F.col("text"), words).alias("item_shingles"))
    item_rows = cut(item_rows.filter(F.size("hashes") > 0).dropDuplicates(["item_id", "row"]))
    sketch = _sketch(item_rows, percent)
    minima, top = sketch.agg(F.count("*"), F.max("part")).first()
    if not minima:
        return texts.select("doc_id").join(item_rows.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).cast("bigint").alias("n_item"))
    candidates = _candidates(texts, sketch, minima, top, words, percent)
    blocks = _blocks(candidates, item_rows)
    asked = cut(candidates.select("doc_id").distinct())
    for table in (sketch, item_rows, candidates):
        drop(table)

    def shared(held: Column) -> Column:
        few = F.array(F.array_intersect(held, F.flatten("items.item_shingles")))
        return F.element_at(F.transform(few, lambda own: F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), F.size(F.array_intersect(i["item_shingles"], own)).alias("n_shared"), F.size(i["item_shingles"]).alias("n_item")))), 1)

    pairs = texts.join(broadcast_if_small(asked, CANDIDATES_A_BROADCAST), "doc_id", "left_semi").join(blocks, "doc_id")
    pairs = pairs.select("doc_id", F.explode(F.element_at(F.transform(F.array(_shingles(F.col("text"), words)), shared), 1)).alias("pair"))
    pairs = pairs.select("doc_id", "pair.*").filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_shared").cast("bigint").alias("n_shared"), F.max("n_item").cast("bigint").alias("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that hold no item; rows with a null doc_id stay."""
    found = cut(contained_items(docs, items, words, percent).select("doc_id").distinct())
    return docs.join(broadcast_if_small(found, CANDIDATES_A_BROADCAST), "doc_id", "left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL
), iw AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT ds.doc_id, s.item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item
FROM ds JOIN s ON ds.s = s.s JOIN n ON n.item_id = s.item_id
GROUP BY ds.doc_id, s.item_id HAVING count(*) * 100 >= any_value(n.n_item) * 80
"""
