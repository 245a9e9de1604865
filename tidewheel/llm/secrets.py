"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Base forms are found in every text.  Hashes of the values are then counted over the
corpus by distinct repositories and owners: a value that several owners carry, or
that stands in many repositories, is a widely copied example; one that only its
owner has, in few of them, looks live.  Live values are also
searched for bare, without the assignment that gave them away, and those places are
added to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.session import broadcast_if_small, cut

KINDS = ("assign", "access", "hex")
OWNERS_OF_AN_EXAMPLE = 3
REPOSITORIES_OF_AN_EXAMPLE = 10
LEAST_VALUE = 8
VALUES_A_BROADCAST = 200_000

# The base patterns.  Shorter access and hex runs fail as whole runs do.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}+"
BARE = r"[A-Za-z0-9+/_.=-]{8,}"
UNLIKE_A_WORD = r"[0-9]|[a-z][A-Z]|[A-Za-z]{16}"
PIECES = 256  # walked at once
_OPEN, _CLOSE = "\x01", "\x02"
_SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _marked(text: Column, pattern: str) -> Column:
    """The pieces of `text` (which holds no mark) from each match on; the first piece is what stands before."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)


def _bound(value: Column, make) -> Column:
    """make(value) with the value bound to a lambda variable, so that no optimiser rule copies what it comes from."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _places(text: Column, pattern: str, kind: int, value: str | None = None) -> Column:
    """start, kind, stop and value of each match, in code points; value is the last group of `value`, or the match.

    The pieces are walked in blocks, and each block's spans then moved by the length
    of all blocks before it, so that a text of many matches takes little more than
    linear time (an array grows by copying).
    """

    def matched(piece: Column) -> Column:
        return F.substring_index(piece, _CLOSE, 1)

    def walk(block: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            start, match = state["at"], matched(piece)
            said = F.regexp_extract(match, value, 1) if value else match
            found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("stop"), said.alias("value"))
            return F.struct((start + F.length(piece) - 1).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found")), step)

    def place(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(PIECES)).cast("int")), lambda j: walk(F.slice(pieces, j * PIECES + 2, PIECES)))
        first = F.length(F.element_at(pieces, 1))

        def moved(walked: Column) -> Column:
            before = F.aggregate(walked, F.array(first), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w["at"])))
            shift = F.transform(F.arrays_zip(walked["found"].alias("found"), F.slice(before, F.lit(1), F.size(walked)).alias("by")), lambda z: F.transform(z["found"], lambda s: F.struct((s["start"] + z["by"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + z["by"]).alias("stop"), s["value"].alias("value"))))
            return F.flatten(shift)

        return F.when(n > 0, _bound(blocks, moved)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.when(text.rlike(pattern), _bound(_marked(text, pattern), place)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _clean(text: Column) -> Column:
    """Marks within a text become another control character; no pattern takes either."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _OPEN + _CLOSE, "\x03\x03")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


_KEY = ["h1", "h2"]


def secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example and n_live for each row of `docs`.

    Reads doc_id, text and the columns that name repository and owner.  Counts and
    hash are of the base forms; `spans` lists all as kind:start:end by start and
    then kind (code points, end exclusive), a bare live value under the kind that
    gave it away.  A bare value is a run of value characters, whole or without the
    `key=` before it or the `.`, `/` and `=` after it, that has a digit, a capital
    after a small letter, or 16 letters on end: shorter values spelt like words
    would be found in plain prose.  n_example counts base values that
    `OWNERS_OF_AN_EXAMPLE` or more owners carry or that
    `REPOSITORIES_OF_AN_EXAMPLE` or more repositories hold, n_live those of one
    owner in fewer repositories.  Null owners count as one owner, null repositories
    as one repository.  Null and empty texts have no spans.  Equal texts have equal
    results, whatever their doc_id, a null one too.  No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), _clean(F.col("text")).alias("text"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})
    text = F.col("text")
    assign = F.filter(_places(text, ASSIGN, 0, ASSIGN), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    spans = F.array_sort(F.concat(assign, _places(text, ACCESS, 1), _places(text, HEX, 2)))
    found = cut(rows.select("doc_id", *_KEY, "repository", "owner", spans.alias("base")))

    some = found.filter(F.size("base") > 0)
    size = some.agg(F.sum(F.size("base"))).first()[0] or 0
    values = some.select(*_KEY, "repository", "owner", F.explode("base").alias("s")).select(*_KEY, "repository", "owner", "s.kind", F.sha2(F.col("s.value").cast("binary"), 256).alias("secret"))
    repositories = values.groupBy("secret", "owner", "repository").agg(F.min("kind").alias("kind"))
    owners = repositories.groupBy("secret", "owner").agg(F.count("*").alias("repositories"), F.min("kind").alias("kind"))
    owned = cut(owners.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.min("kind").alias("kind")), rows=size)
    example = (F.col("owners") >= OWNERS_OF_AN_EXAMPLE) | (F.col("repositories") >= REPOSITORIES_OF_AN_EXAMPLE)
    judged = owned.select("secret", "kind", example.alias("example"), (~example & (F.col("owners") == 1)).alias("live"))
    verdicts = values.select(*_KEY, "secret").distinct().join(judged.drop("kind"), "secret")
    verdicts = cut(verdicts.groupBy(*_KEY).agg(F.count_if("example").alias("n_example"), F.count_if("live").alias("n_live")), rows=size)

    added = _bare(rows, judged.filter("live").select("secret", F.col("kind").alias("bare_kind")))
    out = found.join(broadcast_if_small(verdicts, VALUES_A_BROADCAST), _KEY, "left").join(added, _KEY, "left")
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    every = F.array_sort(F.concat(base, F.coalesce("bare", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    count = [F.aggregate("base", F.lit(0).cast("bigint"), _counter(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def _counter(kind: int):
    return lambda n, span: n + (span["kind"] == kind).cast("bigint")


def _blanked(text: Column) -> Column:
    """`text` with its base matches taken out of reach: each becomes blanks of its length."""
    for pattern in (ASSIGN, ACCESS, HEX):
        pieces = _marked(text, pattern)
        rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.concat(F.rpad(F.lit(""), F.length(F.substring_index(p, _CLOSE, 1)), " "), F.substring_index(p, _CLOSE, -1)))
        text = F.when(text.rlike(pattern), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(text)
    return text


def _forms(run: Column) -> Column:
    """off and value of what may be meant by a run: whole, after its first or last `key=`, and without the end of a sentence, path or padding."""
    core = F.rtrim(run, F.lit("./="))
    heads = F.array_distinct(F.array(F.lit(0), F.length(F.regexp_extract(core, "^([^=]*=+)", 1)), F.length(F.regexp_extract(core, "^(.*=)", 1))))
    ends = F.array_distinct(F.array(run, F.rtrim(run, F.lit("./")), core))
    forms = F.flatten(F.transform(heads, lambda h: F.transform(ends, lambda e: F.struct(h.alias("off"), F.substr(e, h + 1).alias("value")))))
    return F.filter(forms, lambda f: (F.length(f["value"]) >= LEAST_VALUE) & f["value"].rlike(UNLIKE_A_WORD))


def _bare(rows: DataFrame, live: DataFrame) -> DataFrame:
    """h1, h2 and the spans `bare` of live values that stand outside base matches; of a run's forms the longest counts.

    A text's known values come as one row for each text and value, so that no row
    holds more than one text with the values that stand in it.
    """
    tokens = rows.filter(F.col("text").rlike(UNLIKE_A_WORD)).select(*_KEY, _blanked(F.col("text")).alias("text"))
    runs = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(f"({BARE})"), F.lit(1)), lambda t: t.rlike(UNLIKE_A_WORD)))
    tokens = tokens.select(*_KEY, F.explode(runs).alias("run")).select(*_KEY, F.explode(_forms(F.col("run"))["value"]).alias("token"))
    hits = tokens.select(*_KEY, F.sha2(F.col("token").cast("binary"), 256).alias("secret")).join(broadcast_if_small(live, VALUES_A_BROADCAST), "secret")
    hits = cut(hits.distinct())
    n = hits.count()
    known = cut(hits.groupBy(*_KEY).agg(F.map_from_entries(F.collect_set(F.struct("secret", "bare_kind"))).alias("known")))
    if n <= VALUES_A_BROADCAST:  # counts values, so the maps together hold no more
        known = F.broadcast(known)
    texts = rows.select(*_KEY, "text").join(known, _KEY).select(*_KEY, "known", _blanked(F.col("text")).alias("text"))

    def longest(run: Column) -> Column:
        held = F.filter(_forms(run), lambda f: F.map_contains_key("known", F.sha2(f["value"].cast("binary"), 256)))
        return F.array_max(F.transform(held, lambda f: F.struct(F.length(f["value"]).alias("n"), (-f["off"]).alias("before"), F.element_at("known", F.sha2(f["value"].cast("binary"), 256)).alias("kind"))))

    found = F.transform(_places(F.col("text"), BARE, 0), lambda s: F.struct(s["start"].alias("start"), longest(s["value"]).alias("hit")))
    found = F.filter(found, lambda s: s["hit"].isNotNull())
    spans = F.transform(found, lambda s: F.struct((s["start"] - s["hit"]["before"]).alias("start"), s["hit"]["kind"].alias("kind"), (s["start"] - s["hit"]["before"] + s["hit"]["n"]).alias("stop")))
    bare = cut(texts.select(*_KEY, spans.alias("bare")).groupBy(*_KEY).agg(F.first("bare").alias("bare")))
    spans = bare.agg(F.count("*") + F.sum(F.size("bare"))).first()[0] or 0
    return F.broadcast(bare) if spans <= VALUES_A_BROADCAST else bare
