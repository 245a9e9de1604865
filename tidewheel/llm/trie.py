"""The prefix trie of rebuilt conversations by prefix doubling.

Blocks of 1, 2, 4, ... turns that begin at multiples of their size get dense names: a
block's name stands for the pair of its halves' names.  A level costs one naming of
distinct pairs and one join back, there are log2(longest) levels, and all levels
together have twice as many rows as there are turns.  The prefix of depth d is then
the list of at most log2(d) block names that the binary digits of d pick, and equal
lists are one node.

No text is shuffled, only its digest and length.  What is summed over a subtree is
put on the smallest member of each node, summed backwards along that conversation
and then over each node's members, so no node meets its descendants.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.session import cut, drop

CENTURY, TAKEN_BELOW = 100, 6  # a conversation takes fewer than TAKEN_BELOW first turns of the first of its hundred
RUN_BITS = 8  # turns are ordered within runs of 2^RUN_BITS, and only totals of runs meet
CHUNK_BITS = 10  # ids of a node are joined within ranges of 2^CHUNK_BITS
LARGE_NODES, LARGE_LEAST = 4096, 500  # nodes that are joined by broadcast: this many at most, of this many members at least
BEFORE_ALL = -(1 << 62)  # the run of null turns
PART_BITS = 33  # of a row's place in its partition, in monotonically_increasing_id


def _named(pairs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Dense names from 0 of the distinct `key` of `pairs` (key, name), and the table to drop after them.

    Rows are numbered within the partitions of a written table; one row a partition,
    at most as many as there are shuffle partitions, says where its numbers start.
    """
    rows = cut(pairs.select(*key).distinct().withColumn("_at", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright("_at", PART_BITS).alias("_part")).agg(F.count("*").alias("_n"))
    starts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    placed = rows.withColumn("_part", F.shiftright("_at", PART_BITS)).join(F.broadcast(starts), "_part")
    return placed.select(*key, (F.col("_start") + F.col("_at").bitwiseAND((1 << PART_BITS) - 1)).alias("name")), rows


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1, by turn, null first, then digest), digest, chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.char_length(text).cast("bigint").alias("chars"))
    rows = rows.filter("conv is not null").withColumn("run", F.coalesce(F.shiftright("turn", RUN_BITS), F.lit(BEFORE_ALL)))
    runs = rows.groupBy("conv", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("run")) - F.col("n")
    rows = rows.join(runs.select("conv", "run", before.alias("before")), ["conv", "run"])
    place = F.row_number().over(Window.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv", (place + F.col("before")).cast("bigint").alias("pos"), "digest", "chars")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conv, pos, name, chars: the rebuilt conversations (conv, len, at least one row each) and their turns (conv, b from 0, name, chars, len)."""
    own = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % TAKEN_BELOW
    convs = own.select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % CENTURY).alias("donor"))
    convs = convs.join(own.select(F.col("conv").alias("donor"), F.col("n").alias("dn")), "donor", "left").withColumn("head", F.least("h", F.coalesce("dn", F.lit(0))))
    convs = cut(convs.select("conv", "donor", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    tails = turns.join(convs, "conv").filter("pos > h").select("conv", (F.col("head") + F.col("pos") - F.col("h") - 1).alias("b"), "name", "chars", "len")
    first = turns.filter((F.col("pos") < TAKEN_BELOW) & (F.col("conv") % CENTURY == 0)).withColumnRenamed("conv", "donor")
    heads = first.join(convs, "donor").filter("pos <= h").select("conv", (F.col("pos") - 1).alias("b"), "name", "chars", "len")
    return convs, heads.unionByName(tails)


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Named blocks of 2^j turns for each j with 2^j <= longest: conv, b (which block), name, len."""
    levels = [turns]
    while 2 ** len(levels) <= longest:
        half = F.col("b").bitwiseAND(1)
        pairs = levels[-1].groupBy("conv", F.shiftright("b", 1).alias("up")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"), F.max("len").alias("len"))
        pairs = pairs.filter("left is not null and right is not null")
        names, table = _named(pairs, ["left", "right"])
        levels.append(cut(pairs.join(names, ["left", "right"]).select("conv", F.col("up").alias("b"), "name", "len")))
        drop(table)
    return levels


def _prefixes(convs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """conv, depth, key (the block names of its binary digits), chars of its last turn, len; the root for every conversation."""
    kind = "struct<j int, name bigint>"
    rows = levels[0].select("conv", (F.col("b") + 1).alias("depth"), "chars", "len", F.lit(None).cast(kind).alias("part"))
    for j, level in enumerate(levels):
        first, last = F.shiftleft(F.col("b") + 1, j), F.least(F.shiftleft(F.col("b") + 2, j) - 1, F.col("len"))
        used = level.filter(F.col("b").bitwiseAND(1) == 0).select("conv", F.explode(F.sequence(first, last)).alias("depth"), F.lit(None).cast("bigint").alias("chars"), "len", F.struct(F.lit(j).alias("j"), "name").cast(kind).alias("part"))
        rows = rows.unionByName(used)
    key = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["name"])
    rows = rows.groupBy("conv", "depth").agg(key.alias("key"), F.max("chars").alias("chars"), F.max("len").alias("len"))
    root = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.array().cast("array<bigint>").alias("key"), F.lit(0).cast("bigint").alias("chars"), "len")
    return rows.unionByName(root)


def _with_nodes(prefixes: DataFrame) -> DataFrame:
    """The prefixes with their node's rep (smallest member), n_convs and n_ends.

    Nodes with at least one in `LARGE_NODES` of all rows, of which there can be no more
    than `LARGE_NODES`, go to the rows by broadcast; so no key of the shuffled join has
    more rows than that share.
    """
    nodes = prefixes.groupBy("depth", "key").agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"))
    nodes = cut(nodes)
    least = max(LARGE_LEAST, -(-(nodes.agg(F.sum("n_convs")).first()[0] or 0) // LARGE_NODES))
    near = prefixes.join(F.broadcast(nodes.filter(F.col("n_convs") >= least)), ["depth", "key"], "left")
    rest = near.filter("rep is null").select(prefixes.columns).join(nodes.filter(F.col("n_convs") < least), ["depth", "key"])
    return near.filter("rep is not null").unionByName(rest)


def _members(prefixes: DataFrame) -> DataFrame:
    """A row for each conversation and depth with its node: rep, n_convs, whether it ends there, and the node's own weights if it is the smallest member."""
    rows = _with_nodes(prefixes)
    own = F.col("conv") == F.col("rep")
    saved = F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    leaf = F.when(own & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0).cast("bigint")
    return rows.select("conv", "depth", "rep", "n_convs", (F.col("depth") == F.col("len")).alias("ends"), saved.alias("saved"), leaf.alias("leaf"))


def _onwards(members: DataFrame) -> DataFrame:
    """rep, depth, and the weights of a conversation from this depth on, within runs of depths and from their totals."""
    rows = members.withColumn("run", F.shiftright("depth", RUN_BITS))
    totals = rows.groupBy("conv", "run").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    after = Window.partitionBy("conv").orderBy(F.col("run").desc())
    totals = totals.select("conv", "run", *[(F.sum(c).over(after) - F.col(c)).alias(c) for c in ("s", "l")])
    own = Window.partitionBy("conv", "run").orderBy(F.col("depth").desc())
    return rows.join(totals, ["conv", "run"]).select("rep", "depth", (F.sum("saved").over(own) + F.col("s")).alias("saved"), (F.sum("leaf").over(own) + F.col("l")).alias("leaf"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which follow each other in order; one hash state is held, whatever the number of chunks."""
    node, state = None, hashlib.sha256()
    names = ["conv_id", "depth", "sha"]
    for batch in batches:
        done = []
        for *key, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(chunk.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names=names)


def _ends(members: DataFrame) -> DataFrame:
    """conv_id, depth, sha of the ids that end at a node, ascending and comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = members.filter("ends").groupBy("rep", "depth", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "chunk")
    return chunks.select("rep", "depth", "ids").mapInArrow(_digests, "conv_id bigint, depth bigint, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Reads conv_id, turn, role and text; other columns, whatever their names, are not
    read.  Rows with a null conv_id belong to no conversation and take no part.  A null
    role or text is empty; turns are ordered by turn, null first, and rows of one turn by
    the SHA-256 of role and text, equal rows counting each.  A conversation that
    loses all its turns is a member of the root alone.  No conversations give no rows.
    """
    turns = cut(_turns(conversations))
    names, table = _named(turns, ["digest"])
    named = cut(turns.join(names, "digest").drop("digest"))
    drop(turns)
    drop(table)
    convs, rebuilt = _rebuilt(named)
    rebuilt = cut(rebuilt)
    drop(named)
    levels = _blocks(rebuilt, convs.agg(F.max("len")).first()[0] or 0)
    prefixes = cut(_prefixes(convs, levels))
    for table in [convs, *levels]:
        drop(table)
    members = cut(_members(prefixes))
    drop(prefixes)

    def facts(rows: DataFrame, **has: Column) -> DataFrame:
        kinds = {"n_convs": "bigint", "parent": "bigint", "child": "bigint", "leaf": "bigint", "saved": "bigint", "sha": "string"}
        return rows.select("conv_id", "depth", *[has.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    heads = members.filter("conv = rep").select(F.col("conv").alias("conv_id"), "depth", "n_convs")
    above = members.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "rep")
    linked = heads.join(above, ["conv_id", "depth"])
    upwards = linked.select(F.explode(F.array(F.struct("conv_id", "depth", F.col("rep").alias("parent"), F.lit(None).cast("bigint").alias("child")), F.struct(F.col("rep").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(1).cast("bigint").alias("child")))).alias("x")).select("x.*")
    sums = _onwards(members).groupBy(F.col("rep").alias("conv_id"), "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    parts = [facts(heads, n_convs=F.col("n_convs")), facts(upwards, parent=F.col("parent"), child=F.col("child")), facts(sums, leaf=F.col("leaf"), saved=F.col("saved")), facts(_ends(members), sha=F.col("sha"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    nodes = whole.groupBy("conv_id", "depth").agg(F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("sha").alias("sha"))
    return nodes.withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))).drop("sha")


ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, s, i, ascii(s[i])::BIGINT AS byte FROM (SELECT c, c::VARCHAR AS s, unnest(range(1, length(c::VARCHAR) + 1)) AS i FROM (SELECT DISTINCT c FROM t))),
crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list(byte ORDER BY i)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) AS v FROM bits GROUP BY c),
h AS (SELECT c, v % 6 AS h, c - c % 100 AS donor FROM crc),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
r AS (SELECT h.c, t.pos AS d, name, chars FROM h JOIN t ON t.c = h.donor AND t.pos <= h.h
    UNION ALL SELECT h.c, least(h.h, coalesce(n.n, 0)) + t.pos - h.h, name, chars FROM h JOIN t ON t.c = h.c AND t.pos > h.h LEFT JOIN n ON n.c = h.donor),
p AS (SELECT c, d, chars, string_agg(name, ',') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM h),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
v AS (SELECT d, path, min(p.c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, string_agg(CASE WHEN d = len THEN p.c::VARCHAR END, ',' ORDER BY p.c) AS ends FROM p JOIN l ON l.c = p.c GROUP BY d, path),
k AS (SELECT a.d, a.path, count(b.path) AS n_children FROM v a LEFT JOIN v b ON b.d = a.d + 1 AND starts_with(b.path, a.path) GROUP BY ALL),
s AS (SELECT a.d, a.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens FROM v a JOIN v b ON b.d >= a.d AND starts_with(b.path, a.path) JOIN k ON k.path = b.path AND k.d = b.d GROUP BY ALL)
SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN k ON k.d = v.d AND k.path = v.path JOIN s ON s.d = v.d AND s.path = v.path LEFT JOIN v u ON u.d = v.d - 1 AND starts_with(v.path, u.path)
"""
