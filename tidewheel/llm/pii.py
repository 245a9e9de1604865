"""Personal data: exact base forms, and more found by bootstrapped contexts.

Base spans (email, ip, card, phone) are the seeds.  The two words before a seed are
a lexical pattern.  Looser forms of the same kinds are candidate instances.  Spark
scores the pattern-instance graph in rounds: a pattern is trusted by the trusted
instances among all places in the corpus where its words occur, an instance by the
patterns that it follows.  Candidates that end up trusted are added to the spans.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.session import broadcast_if_small, cut
from tidewheel.llm.textkernel import Words, mix64, text_slices, utf8

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS = 3  # different seeds that a pattern must precede
LEAST_TRUST = 0.6
ROUNDS = 3
FILTER_BITS = 24  # of the filter that word pairs pass before they are counted; a full one lets more pass, and none is lost
ROWS_A_BROADCAST = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run matches from its first digit or not at all, so the look-behind only saves retries
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?(?:\(at\)|\[at\]|@) ?[\w-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[\w-]{1,63}){1,8}(?![\w-])"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7})(?![\w:])"),
    "card": re.compile(r"(?<![\w+.-])[0-9](?:[ .-]?[0-9]){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![\w-])"),
}


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            found.append((start, free))
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base forms, by start and then kind; ends are exclusive, places code points."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of candidate forms that overlap no base form (`base` is sorted by start)."""
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    found = []
    for k, kind in enumerate(KINDS):
        for m in _LOOSE[kind].finditer(text):
            before = bisect.bisect_left(starts, m.end())  # base forms that begin before the candidate ends
            if not before or reach[before - 1] <= m.start():
                found.append((m.start(), k, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _pair(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one, from the words' hashes."""
    return mix64(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:]).view(np.int64)


def _byte_places(text: str, places: np.ndarray) -> np.ndarray:
    """Code points to bytes of UTF-8."""
    if text.isascii():
        return places
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[places]


def _contexts(texts: list[str], text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The pair hash of the two words before each start (a code point of its text); 0 where no word begins or two words are missing."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    out = np.zeros(len(start), dtype=np.int64)
    if len(words.hash) < 3:
        return out
    pairs = _pair(words.hash)
    places = np.zeros(len(start), dtype=np.int64)
    for i in np.unique(text):  # the starts are sorted by text
        own = slice(*np.searchsorted(text, [i, i + 1]))
        places[own] = offsets[i] + _byte_places(texts[i], start[own])
    at = np.minimum(np.searchsorted(words.start, places), len(words.start) - 1)
    ok = (words.start[at] == places) & (at - words.first[text] >= 2)
    out[ok] = pairs[at[ok] - 2]
    return out


_KEY = ["h1", "h2"]
_FOUND = "doc_id bigint, h1 bigint, h2 bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, edges array<struct<pattern:bigint,kind:int,instance:string,seed:boolean,start:int,stop:int>>"
_EDGE = pa.struct([("pattern", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text: what is found in a text does not depend on whose it is."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            col = part.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(col, r"[0-9@]|\(at\)|\[at\]"), False).to_pylist()
            counts = np.zeros((part.num_rows, 4), dtype=np.int64)
            bases, edges = [""] * part.num_rows, [[] for _ in range(part.num_rows)]
            texts: list[str] = []
            wanted: list[tuple[int, int, int, int, int, bool]] = []  # row, place in texts, start, kind, stop, seed
            for i in np.flatnonzero(maybe).tolist():
                text = col[i].as_py()
                base = base_spans(text)
                bases[i] = joined(base)
                for _, k, _e in base:
                    counts[i, k] += 1
                spans = [(i, len(texts), *span, True) for span in base] + [(i, len(texts), *span, False) for span in loose_spans(text, base)]
                if spans:
                    texts.append(text)
                    wanted += spans
            if wanted:
                hashes = _contexts(texts, np.asarray([w[1] for w in wanted]), np.asarray([w[2] for w in wanted])).tolist()
                for (i, at, start, kind, stop, seed), h in zip(wanted, hashes, strict=True):
                    if h:
                        instance = hashlib.md5(texts[at][start:stop].lower().encode("utf-8", "replace")).hexdigest()
                        edges[i].append({"pattern": h, "kind": kind, "instance": instance, "seed": seed, "start": start, "stop": stop})
            columns = [part.column("doc_id"), part.column("h1"), part.column("h2"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(bases, pa.string()), pa.array(edges, pa.list_(_EDGE))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "n_email", "n_ip", "n_card", "n_phone", "base", "edges"])


def _occurrences(passing):
    """Word pairs that pass the filter, with how often they stand in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for batch in batches:
            for part in text_slices(batch):
                w = Words(*utf8(part.column("text")))
                if len(w.hash) > 1:
                    pair = _pair(w.hash)[w.text[1:] == w.text[:-1]]
                    slot = (pair.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    pair = pair[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                    if len(pair):
                        value, places = np.unique(pair, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(places)], names=["pattern", "places"])

    return run


def _count_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern's two words occur in the whole corpus, in one pass over it.

    Pairs pass a filter of fixed size, made in Spark and sent to the tasks; those that
    do are summed by task and joined with the patterns.
    """
    slot = F.shiftrightunsigned("pattern", 64 - FILTER_BITS)
    octets = patterns.groupBy(F.shiftright(slot, 3).alias("octet")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)  # bounded whatever the number of patterns
    bits[octets["octet"]] = octets["bits"]
    passing = docs.sparkSession.sparkContext.broadcast(bits)
    pairs = docs.select("text").mapInArrow(_occurrences(passing), "pattern bigint, places bigint")
    return pairs.groupBy("pattern").agg(F.sum("places").alias("places")).join(patterns, "pattern", "left_semi")


def discover(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """h1, h2, start, kind, stop of candidates that the graph trusts; None if no pattern has enough seeds."""
    edges = found.select(*_KEY, F.explode("edges").alias("e")).select(*_KEY, "e.*")
    n = found.agg(F.sum(F.size("edges"))).first()[0] or 0
    patterns = cut(edges.filter("seed").groupBy("pattern", "kind", "instance").count().groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS), rows=n // LEAST_SEEDS)
    if patterns.isEmpty():
        return None
    graph = cut(edges.join(patterns.select("pattern", "kind"), ["pattern", "kind"]).groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), rows=n)
    if graph.filter("not seed").isEmpty():
        return None
    places = cut(_count_patterns(docs, patterns.select("pattern").distinct()), rows=n // LEAST_SEEDS)
    trust = graph.select("kind", "instance", F.col("seed").cast("double").alias("trust")).groupBy("kind", "instance").agg(F.max("trust").alias("trust"))
    for _ in range(ROUNDS):
        scored = graph.join(trust, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum(F.col("trust") * F.col("n")).alias("mass")).join(places, "pattern")
        scored = cut(scored.select("pattern", "kind", F.least(F.lit(1.0), F.col("mass") / (F.col("places") + 1)).alias("confidence")), rows=n // LEAST_SEEDS)
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        trust = cut(graph.join(scored, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max("seed").alias("seed"), doubt.alias("doubt")).select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.col("doubt")).alias("trust")), rows=n)
    trusted = trust.filter(F.col("trust") >= LEAST_TRUST).select("kind", "instance")
    return edges.filter("not seed").join(trusted, ["kind", "instance"]).select(*_KEY, "start", "kind", "stop").distinct()


def _added(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """The trusted candidates `more` of each text that has some, by its hashes; texts repeat, so a group is no larger than one text's candidates."""
    more = discover(docs, found)
    if more is None:
        return None
    rows = found.filter(F.size("edges") > 0).count()
    return broadcast_if_small(cut(more.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more")), rows=rows), ROWS_A_BROADCAST)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of `docs` (doc_id, text).

    Counts and hash are of the base forms; `spans` lists all as kind:start:end by
    start and then kind (code points, end exclusive).  Null and empty texts have
    none.  Equal texts have the same spans, whatever their doc_id, a null one too.
    No rows give no rows.
    """
    docs = _keyed(docs)
    found = cut(docs.mapInArrow(_find, _FOUND))
    added = _added(docs, found)
    out = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = found.select("doc_id", *_KEY, "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.col("base").alias("spans"))
    if added is None:
        return rows.select(out)
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("start"), (F.array_position(names, F.split_part(x, F.lit(":"), F.lit(1))) - 1).cast("int").alias("kind"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("stop")))
    text = F.array_join(F.transform(F.array_sort(F.array_union(parts, F.col("more"))), lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))), ",")
    return rows.join(added, _KEY, "left").withColumn("spans", F.when(F.col("more").isNull(), F.col("spans")).otherwise(text)).select(out)


def redact(text: str, spans: str) -> str:
    """`text` with each span replaced by its kind in brackets; of a span that overlaps earlier ones the rest is."""
    out, free = [], 0
    for span in spans.split(",") if spans else ():
        kind, start, stop = span.split(":")
        if int(start) >= free:
            out += [text[free : int(start)], f"[{kind.upper()}]"]
            free = int(stop)
        elif int(stop) > free:
            out.append(f"[{kind.upper()}]")
            free = int(stop)
    return "".join([*out, text[free:]])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a table with the added spans in a last column, which goes."""
    for batch in batches:
        for part in text_slices(batch):
            names = part.schema.names[:-1]
            col, more = part.column("text"), part.column(len(names)).to_pylist()
            maybe = pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_pylist()
            texts = col.to_pylist()
            for i, text in enumerate(texts):
                if maybe[i] or more[i]:
                    extra = [(m["start"], m["kind"], m["stop"]) for m in more[i] or ()]
                    texts[i] = redact(text, joined(sorted(base_spans(text) + extra)))
            columns = {n: part.column(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                size = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                columns["n_chars"] = pc.if_else(pc.is_valid(columns["n_chars"]), size, None).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind in brackets; a non-null n_chars is counted again.

    All rows and columns stay, whatever their names; null and empty texts stay as they are.
    """
    rows = _keyed(docs)
    added = _added(rows, cut(rows.mapInArrow(_find, _FOUND).drop("base").filter(F.size("edges") > 0)))
    own = "_"  # begins the names that are added here, and no other
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    h1, h2, more = (f"{own}{c}" for c in ("h1", "h2", "more"))
    if added is None:
        marked = docs.withColumn(more, F.lit(None).cast("array<struct<start:int,kind:int,stop:int>>"))
    else:
        text = docs["text"].cast("string")
        on = (F.xxhash64(text) == F.col(h1)) & (F.xxhash64(text, F.lit(1)) == F.col(h2))
        marked = docs.join(added.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("more").alias(more)), on, "left").drop(h1, h2)
    return marked.mapInArrow(_redacted, docs.schema)
