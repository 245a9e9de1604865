"""Near-duplicate documents by b-bit MinHash, with exact confirmation.

Texts with equal shingle sets fold into one class first.  Class representatives
get `HASHES` minima; `BANDS` keys over the whole minima select candidates, and the
minima's low `BITS` bits, packed, estimate the similarity of a candidate pair with
the chance collisions of b bits taken out.  Only pairs whose estimate comes within
`MARGIN` of the threshold are confirmed, on the full sets.

Groups of any size: no bucket is ever expanded into its pairs.  A bucket is dealt
out in blocks of about `BLOCK` rows.  The first round confirms, for each document,
the most similar of a few leaders of its block, the second its most similar
partner that is still in another component.  After those a group of thousands of
near copies is one component but for its outliers, and the last round compares
these, and whatever else shares a bucket across components, with every block of
their bucket; it confirms inside the task, so that only links come out.

A bucket with more than `BLOCK` rows outside its largest component is no group of
copies: its texts share much, a template say, but not enough.  The last round meets
them by an exact prefix filter instead: with all shingles in one order, rare ones
first, two texts as similar as asked share a shingle that is among the first
n - ceil(0.8 n) + 1 of each, and among the first n - ceil(1.6 n / 1.8) + 1 of the
smaller one, which leads.  A template's shingles are frequent, so nobody leads there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.components import components
from tidewheel.llm.session import broadcast_if_small, cut, drop
from tidewheel.llm.textkernel import Words, mix64, text_slices, utf8

HASHES, BANDS, BITS = 128, 32, 4
MARGIN = 0.22  # over five standard deviations of the estimate at a similarity of 0.8
LEADERS = 4
BLOCK = 256
DROPPED_A_BROADCAST = 500_000
LABELS_A_BROADCAST = 500_000
FREQUENCY_BITS = 20  # shingle frequencies are kept for so many bits of the hash; any order is right, this one is quick

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pack_low_bits(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, packed: one row of bytes per row of minima."""
    low = (mix64(minima)[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8).reshape(len(minima), minima.shape[1] * bits), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarities of packed signatures: rows of `a` by rows of `b`.

    The share of equal values c contains a chance collision rate of 2^-bits, so
    the estimate is (c - 2^-bits) / (1 - 2^-bits).
    """
    x = a[:, None, :] ^ b[None, :, :]
    if bits == 4 and a.shape[1] % 8 == 0:
        x = np.ascontiguousarray(x).view(np.uint64)
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int32)
    else:
        unequal = np.unpackbits(x, axis=2).reshape(*x.shape[:2], -1, bits).any(axis=3).sum(axis=2)
    n = a.shape[1] * 8 // bits
    chance = 2.0**-bits
    return ((n - unequal) / n - chance) / (1 - chance)


def _describe(k: int):
    rows = HASHES // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h, offs = Words(*utf8(part.column("text"))).shingle_sets(k)
                n = np.diff(offs)
                some = n > 0
                at = offs[:-1][some]
                digest = np.zeros((len(n), 2), dtype=np.uint64)
                minima = np.zeros((int(some.sum()), HASHES), dtype=np.uint64)
                if len(at):
                    for j, salt in enumerate((np.uint64(11), np.uint64(29))):
                        digest[some, j] = np.add.reduceat(mix64(h + salt), at)
                    for j in range(HASHES):
                        minima[:, j] = np.minimum.reduceat(h * _SEEDS[j], at)
                keys = np.zeros((len(minima), BANDS), dtype=np.uint64)
                for b in range(BANDS):
                    key = np.full(len(minima), b + 1, dtype=np.uint64)
                    for j in range(b * rows, (b + 1) * rows):
                        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + minima[:, j])
                    keys[:, b] = key
                packed = pack_low_bits(minima)
                width = packed.shape[1]
                sig_at = np.zeros(len(n) + 1, np.int32)
                sig_at[1:] = np.cumsum(some * width)
                band_at = np.zeros(len(n) + 1, np.int32)
                band_at[1:] = np.cumsum(some * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n.astype(np.int64)),
                        pa.array(digest[:, 0].view(np.int64)),
                        pa.array(digest[:, 1].view(np.int64)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(sig_at), pa.py_buffer(np.ascontiguousarray(packed))]),
                        pa.ListArray.from_arrays(pa.array(band_at), pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (key, x, y), whose rows come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in ("key", "x", "y")]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            now = tuple(int(c[s]) for c in cols)
            if now != last and held:
                yield pa.concat_batches(held)
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.concat_batches(held)


def _signatures(group: pa.RecordBatch) -> np.ndarray:
    sig = group.column("sig").cast(pa.large_binary())
    offs = np.frombuffer(sig.buffers()[1], np.int64)[sig.offset : sig.offset + len(sig) + 1]
    return np.frombuffer(sig.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(sig), -1)


def _best(least: float, stars: bool):
    """Each row's most similar partner in another component of its group, if its estimate is at least `least`.

    With `stars` the partners are `LEADERS` rows and the least id; else any row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = 0

        def made():
            a, b, s = (np.concatenate(z) for z in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "est"])

        for group in _groups(batches):
            ids, comp = np.asarray(group.column("id")), np.asarray(group.column("comp"))
            if (comp == comp[0]).all():
                continue
            sig = _signatures(group)
            if stars:
                order = np.argsort(mix64(ids.view(np.uint64)), kind="stable")[:LEADERS]
                others = np.unique(np.append(order, np.argmin(ids)))
            else:
                others = np.arange(len(ids))
            for s in range(0, len(ids), 512):
                est = estimate(sig[s : s + 512], sig[others])
                est[comp[s : s + 512, None] == comp[None, others]] = -1
                j = est.argmax(axis=1)
                top = est[np.arange(len(j)), j]
                ok = top >= least
                out.append((ids[s : s + 512][ok], ids[others[j[ok]]], top[ok]))
                waiting += int(ok.sum())
            if waiting > 20_000:
                yield made()
                out, waiting = [], 0
        if out:
            yield made()

    return run


def _crossing(group: pa.RecordBatch, least: float) -> np.ndarray:
    """Which rows may be linked: of different components and, in a group of two blocks, of different blocks.

    A group of one block holds its rows, and maybe visitors from the bucket's other blocks.
    """
    comp, block = np.asarray(group.column("comp")), np.asarray(group.column("block"))
    sig = _signatures(group)
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    values, counts = np.unique(comp, return_counts=True)
    ok = np.zeros((len(comp), len(comp)), dtype=bool)
    rows = np.flatnonzero(comp != values[np.argmax(counts)])  # pairs within the largest component need no test
    for s in range(0, len(rows), 256):
        r = rows[s : s + 256]
        ok[r] = (estimate(sig[r], sig) >= least) & (comp[r][:, None] != comp[None, :])
        if x != y:
            ok[r] &= block[r][:, None] != block[None, :]
        else:  # two visitors meet where one of them is at home
            ok[r] &= (block[r][:, None] == x) | (block[None, :] == x)
    return ok


def _involved(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows > 1:
                ok = _crossing(group, least)
                rows = ok.any(axis=0) | ok.any(axis=1)
                if rows.any():
                    yield group.filter(pa.array(rows))

    return run


def _links(k: int, percent: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ok = _crossing(group, least)
            ids, comp = np.asarray(group.column("id")), np.asarray(group.column("comp"))
            sets = [Words(*utf8(part.column("text"))).shingle_sets(k) for part in text_slices(group)]
            h = np.concatenate([s[0] for s in sets])
            n = np.concatenate([np.diff(s[1]) for s in sets])
            at = np.concatenate([[0], np.cumsum(n)])
            row = np.repeat(np.arange(len(n)), n)
            a, b = [], []
            for i in np.flatnonzero(ok.any(axis=1)):
                own = h[at[i] : at[i + 1]]
                shared = np.bincount(row[own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h], minlength=len(n))
                linked = np.flatnonzero(ok[i] & (100 * shared >= percent * (n[i] + n - shared)))
                _, first = np.unique(comp[linked], return_index=True)  # one link to each component joins them
                a += [ids[i]] * len(first)
                b += ids[linked[first]].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in text_slices(batch, "text_a"):
                for part in text_slices(half, "text_b"):
                    ha, oa = Words(*utf8(part.column("text_a"))).shingle_sets(k)
                    hb, ob = Words(*utf8(part.column("text_b"))).shingle_sets(k)
                    na, nb = np.diff(oa), np.diff(ob)
                    row = np.repeat(np.tile(np.arange(len(na)), 2), np.concatenate([na, nb]))
                    both = np.concatenate([ha, hb])
                    order = np.lexsort((both, row))
                    both, row = both[order], row[order]
                    same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                    shared = np.bincount(row[1:][same], minlength=len(na))
                    linked = 100 * shared >= percent * (na + nb - shared)
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


def _frequencies(k: int):
    """How often shingles occur by the top bits of their hash, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch):
                h, _ = Words(*utf8(part.column("text"))).shingle_sets(k)
                total += np.bincount((h >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def _prefixes(k: int, percent: int, frequency):
    """(id, key, lead) for the shingles of each text's prefix: rare ones first; those lead that must meet a text at least as large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for batch in batches:
            for part in text_slices(batch):
                h, offs = Words(*utf8(part.column("text"))).shingle_sets(k)
                n = np.diff(offs)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, often[(h >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)], row))
                place = np.arange(len(h)) - np.repeat(offs[:-1], n)
                kept = place < np.repeat(n + (-percent * n) // 100 + 1, n)
                lead = place < np.repeat(n + (-2 * percent * n) // (100 + percent) + 1, n)
                first = order[kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("id"))[row[first]]), pa.array(h[first].view(np.int64)), pa.array(lead[kept])], names=["id", "key", "lead"])

    return run


def _by_prefix(texts: DataFrame, ids: DataFrame, signed: DataFrame, words: int, percent: int) -> DataFrame:
    """Buckets (id, key, lead, n, leads, sig) of the texts with `ids` that share a shingle of their prefixes, at which one of them leads."""
    own = texts.join(ids, "id", "left_semi").select("id", "text")
    table = own.mapInArrow(_frequencies(words), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)  # bounded: one number for each value of the top bits
    often[table["bucket"]] = table["n"]
    shared = own.sparkSession.sparkContext.broadcast(often)
    keyed = _shared_keys(own.mapInArrow(_prefixes(words, percent, shared), "id bigint, key bigint, lead boolean"))
    return keyed.withColumn("leads", F.count_if("lead").over(Window.partitionBy("key"))).filter("leads > 0").join(signed, "id")


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (id, key) whose key is not theirs alone, with the number `n` of its rows: one shuffle."""
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Each key with rows of several components: the largest component, and how many rows are in others."""
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    found = sizes.agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all")).filter("m.c < all")
    return found.select("key", F.col("m.comp").alias("largest"), (F.col("all") - F.col("m.c")).alias("others"))


def _blocked(members: DataFrame) -> DataFrame:
    """Adds the number `g` of blocks of each bucket and the `block` of each row."""
    return members.withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "g").cast("int"))


def _met(labelled: DataFrame, visits: Column, few: Column) -> DataFrame:
    """The rows of each meeting (key, x, y), in order: x = y where a block is at home, else two blocks of it."""
    rows = labelled.withColumn("other", F.explode(visits))
    x, y = (F.when(few, F.col("other")).otherwise(f("block", "other")) for f in (F.least, F.greatest))
    rows = rows.select("key", x.alias("x"), y.alias("y"), "id", "comp", "block", "sig")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs` (doc_id, text; other columns are not read).

    Words are runs without ASCII white space, A-Z lowered; a text's set holds its
    distinct `words`-word shingles, or its whole sequence if it has fewer words.
    Two rows are linked if 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable over links, kept says doc_id = component_id.

    Null, empty and wordless texts have n_shingles 0 and are linked with nothing.
    Rows with equal texts (repeated rows too) share a component; rows with a null
    doc_id stay out of links unless a row with an id has an equal set; then they
    take its component.  kept is false for them.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    described = cut(docs.mapInArrow(_describe(words), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary, bands array<bigint>"))
    size = described.count()
    # any row of a class has the class's signature; the least id decides which is named
    classes = cut(described.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), rows=size)
    reps = cut(described.join(classes.select(F.col("id").alias("doc_id"), F.col("d1").alias("c1"), F.col("d2").alias("c2")), "doc_id").filter("d1 = c1 and d2 = c2").select(F.col("doc_id").alias("id"), "sig", "bands").dropDuplicates(["id"]))
    signed = reps.select("id", "sig")
    members = cut(_shared_keys(reps.select("id", F.explode("bands").alias("key"))).join(signed, "id"))
    candidates = cut(members.select("id").distinct(), rows=size)
    texts = docs.withColumnRenamed("doc_id", "id").join(candidates, "id").join(classes.select("id", "d1", "d2"), "id")
    texts = cut(texts.mapInArrow(_own(words), "id bigint, text string").dropDuplicates(["id"]))

    least = percent / 100 - MARGIN
    bands = _blocked(members)
    label = candidates.select(F.col("id"), F.col("id").alias("comp"))
    found = None
    home, everywhere = F.array("block"), F.sequence(F.lit(0), F.col("g") - 1)

    def join(links: DataFrame) -> None:
        """Adds confirmed links to what was found and names the components anew."""
        nonlocal found, label
        if not links.isEmpty():
            found = links if found is None else found.union(links)
            label = cut(candidates.join(components(found).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("comp")), rows=size)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(label, LABELS_A_BROADCAST), "id")

    for leaders in (True, False):
        rows = labelled(bands)
        if not leaders:
            rows = rows.join(_mixed(rows).select("key"), "key", "left_semi")
        best = _met(rows, home, F.lit(True)).mapInArrow(_best(least, leaders), "a bigint, b bigint, est double")
        best = best.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
        pairs = cut(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows=size)
        sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        join(cut(sides.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a bigint, b bigint, linked boolean").filter("linked").select("a", "b"), rows=size))

    def across(rows: DataFrame, visitor: Column, few: Column) -> DataFrame:
        """The links between components: few visitors go to every block of their bucket; many rows meet block by block."""
        met = _met(rows, F.when(few & ~visitor, home).otherwise(everywhere), few)
        involved = cut(met.mapInArrow(_involved(least), met.schema))
        met = involved.join(texts, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        links = cut(met.mapInArrow(_links(words, percent, least), "a bigint, b bigint"), rows=involved.count())
        drop(involved)
        return links

    rows = labelled(bands)
    mixed = cut(_mixed(rows), rows=BANDS * size)
    outside = F.col("comp") != F.col("largest")
    small = across(rows.join(mixed.filter(F.col("others") <= BLOCK), "key"), outside, F.lit(True))
    many = mixed.filter(F.col("others") > BLOCK).select("key")
    if many.isEmpty():
        join(small)
    else:
        ids = cut(members.join(many, "key", "left_semi").select("id").distinct(), rows=size)
        rows = labelled(_blocked(cut(_by_prefix(texts, ids, signed, words, percent))))
        rows = rows.join(_mixed(rows), "key")
        visitor = F.when(F.col("others") <= F.col("leads"), outside).otherwise(F.col("lead"))
        join(cut(small.union(across(rows, visitor, F.least("others", "leads") <= BLOCK)), rows=size))

    by_class = classes.join(label, "id", "left").select("d1", "d2", F.coalesce("comp", "id").alias("component_id"))
    by_class = cut(by_class.withColumn("full", F.lit(True)), rows=size)
    for table in (reps, members, texts):
        drop(table)
    full = F.col("n_shingles") > 0
    rows = described.select("doc_id", "n_shingles", "d1", "d2", full.alias("full"))
    joined = rows.join(by_class, ["d1", "d2", "full"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _numbered(rows: DataFrame, again: DataFrame) -> DataFrame:
    """`rows` with an id of its own for each text of a repeated doc_id; the text of the least hash keeps the id."""
    rows = rows.withColumn("hash", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = rows.join(again, rows["id"] == again["again"]).select("again", F.col("hash").alias("digest")).distinct()
    texts = cut(texts)
    first = texts.groupBy("again").agg(F.min("digest").alias("first"))
    top = rows.agg(F.max("id")).first()[0]
    others = texts.join(first, "again").filter("digest > first").select("again", "digest", (F.monotonically_increasing_id() + F.lit(top + 1)).alias("number"))
    others = broadcast_if_small(cut(others, rows=texts.count()), DROPPED_A_BROADCAST)
    joined = rows.join(others, (rows["id"] == others["again"]) & (rows["hash"] == others["digest"]), "left")
    return joined.select("doc", F.coalesce("number", "id").alias("id"), "own", "text")


def without_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stand for their group: one row of each component, and all rows with a null doc_id.

    Where a doc_id repeats, each of its texts is decided on by itself.  Columns of any
    other name go along in one struct, so no name clashes with those used here.
    """
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), F.col("doc_id").cast("bigint").alias("id"), F.col("doc_id").cast("bigint").alias("own"), F.col("text").cast("string").alias("text"))
    size = docs.count()
    again = cut(rows.filter("own is not null").groupBy("own").count().filter("count > 1").select(F.col("own").alias("again")), rows=size)
    repeated = not again.isEmpty()
    if repeated:
        again = broadcast_if_small(again, DROPPED_A_BROADCAST)
        rows = _numbered(rows, again)
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), "text"), words, percent)
    dropped = cut(found.filter("doc_id is not null and not kept").select(F.col("doc_id").alias("id")).distinct(), rows=size)
    rows = rows.join(broadcast_if_small(dropped, DROPPED_A_BROADCAST), "id", "left_anti")
    if not repeated:
        return rows.select("doc.*")
    match = F.col("own") == F.col("again")
    once = rows.join(again, match, "left_semi").dropDuplicates(["id"])
    return rows.join(again, match, "left_anti").select("doc.*").union(once.select("doc.*"))


def _own(k: int):
    """Keeps the rows whose text has the class digest that stands beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h, offs = Words(*utf8(part.column("text"))).shingle_sets(k)
                some = np.diff(offs) > 0
                ok = np.zeros(len(some), dtype=bool)
                if some.any():
                    first = np.add.reduceat(mix64(h + np.uint64(11)), offs[:-1][some]).view(np.int64)
                    ok[some] = first == np.asarray(part.column("d1"))[some]
                yield part.select(["id", "text"]).filter(pa.array(ok))

    return run
