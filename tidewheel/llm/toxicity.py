"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

The lexicon is learned: a term (or a stem that many terms share) is weighted by how
much more often it stands in toxic texts than in others.  It is counted by distinct
contexts in both, so that copies of one text count once.  Folding maps homoglyphs and digit substitutions to
letters one to one, so hits keep their places and word boundaries are checked on
the text as written.  Hits inside exception phrases don't count.  The total weight,
alone and normalised by length, gives the score through a logistic curve.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.langid import held_out
from tidewheel.llm.session import broadcast_if_small, cut
from tidewheel.llm.textkernel import text_slices

TRAIN_ROWS = 12_000  # at most about so many labelled rows are learned from, chosen by a hash of doc_id
SAMPLE_BITS = 60  # of the hash that samples
LEAST_CONTEXTS, LEAST_WEIGHT = 5, 3.0
STEM_LETTERS, STEM_TERMS = (4, 5, 6), 5

# Letters of other scripts, full-width letters, digits and signs that are written for Latin letters.
LOOKALIKES = dict(zip("аеорсхуікмтнвѕјԁԛԝαοερτνικυχ", "aeopcxyikmthbsjdqwaoeptvikux", strict=True))
SUBSTITUTES = dict(zip("013457@$", "oieastas", strict=True))
FOLDS = LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | SUBSTITUTES
_TABLE = {ord(a): b for a, b in FOLDS.items()} | {ord(a.upper()): b for a, b in LOOKALIKES.items() if len(a.upper()) == 1}


def fold(text: str) -> str:
    """Lower-cased and folded, with as many characters as `text`."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, text))
    return low.translate(_TABLE)


def fold_column(text: Column) -> Column:
    low = F.lower(text)
    return F.translate(low, "".join(FOLDS), "".join(FOLDS.values()))


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float] = (-3.0, 2.0, 2.0)


class Matcher:
    """The Aho-Corasick automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, float]]] = {}
        for kind, terms in (("word", lexicon.words), ("stem", lexicon.stems), ("exception", dict.fromkeys(map(fold, lexicon.exceptions), 0.0))):
            for term, weight in terms.items():
                entries.setdefault(term, []).append((kind, weight))
        for term, what in entries.items():
            self.automaton.add_word(term, (len(term), what))
        if entries:
            self.automaton.make_automaton()

    def weigh(self, text: str) -> tuple[float, int]:
        """Summed weight and number of the hits in the whole text."""
        if not len(self.automaton):
            return 0.0, 0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, what) in self.automaton.iter(fold(text)):
            start = end - length + 1
            if start and text[start - 1].isalnum():
                continue
            closed = end + 1 == len(text) or not text[end + 1].isalnum()
            for kind, weight in what:
                if kind == "exception":
                    if closed:
                        spared.append((start, end))
                elif kind == "stem" or closed:
                    hits[start] = max(weight, hits.get(start, 0.0))
        if spared and hits:
            spared.sort()
            starts, reach = [a for a, _ in spared], [-1, *itertools.accumulate((b for _, b in spared), max)]
            hits = {s: w for s, w in hits.items() if reach[bisect.bisect_right(starts, s)] < s}
        return sum(hits.values()), len(hits)


def _features(weight: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), 10 * weight / np.sqrt(chars + 100)], axis=1)


def _weigh(texts: list[str | None], matcher: Matcher, curve: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, weight, hits and characters of each text; null is empty."""
    weighed = [matcher.weigh(t) if t else (0.0, 0) for t in texts]
    weight, hits = np.asarray([w for w, _ in weighed], dtype=float), np.asarray([n for _, n in weighed], dtype=np.int64)
    chars = np.asarray([len(t or "") for t in texts], dtype=np.int64)
    return 1 / (1 + np.exp(-np.clip(_features(weight, chars) @ np.asarray(curve), -40, 40))), weight, hits, chars


def _weighed(lexicon: Lexicon, beside: str):
    """The column `beside` with score, weight, n_hits and chars of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for part in text_slices(batch):
                columns = [part.column(beside), *map(pa.array, _weigh(part.column("text").to_pylist(), matcher, lexicon.curve))]
                yield pa.RecordBatch.from_arrays(columns, names=[beside, "score", "weight", "n_hits", "chars"])

    return run


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01, 0.1, 0.1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns lexicon, exception phrases and curve from the texts of `docs` whose doc_id `labels` (doc_id, toxic) has.

    All labelled ids are used up to about `rows`, else a sample of that size by a
    hash of doc_id; the lexicon takes every term of theirs that is strong enough.
    Rows with a null in doc_id, toxic or text teach nothing; a doc_id labelled twice
    is toxic if once, and equal rows teach once.  Without labels the lexicon is empty.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    if n > rows:
        marked = marked.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 64 - SAMPLE_BITS) < int(rows / n * (1 << SAMPLE_BITS)))
    marked = broadcast_if_small(cut(marked, rows=2 * rows), 2 * rows)
    sample = cut(docs.select("doc_id", "text").filter("text is not null").join(marked, "doc_id").select(F.col("toxic").cast("int"), "text"))
    words = F.regexp_extract_all(fold_column(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(F.try_element_at("w", i).alias("term"), F.when(i > 1, F.try_element_at("w", i - 1)).alias("prev"), F.try_element_at("w", i + 1).alias("next"))))
    used = sample.select("toxic", words.alias("w")).filter(F.size("w") > 0).select("toxic", at.alias("t")).select("toxic", "t.*").filter("term is not null")
    # two stages: the distinct contexts as hashes, then their number by term
    once = used.groupBy("toxic", "term", F.xxhash64("prev", "next").alias("context")).agg(F.lit(1).alias("one"))
    counted = cut(once.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("q")))
    sums = [F.sum("p").alias("p"), F.sum("q").alias("q")]
    total = counted.agg(*sums).first()
    if not total["p"]:
        return Lexicon({}, {}, tuple(exceptions))

    def weigh(p: Column, q: Column) -> Column:
        return F.log((p + 0.5) / (total["p"] + 1.0)) - F.log((q + 0.5) / (total["q"] + 1.0))

    terms = counted.withColumn("weight", weigh(F.col("p"), F.col("q")))
    strong = (F.col("p") >= LEAST_CONTEXTS) & (F.col("weight") >= LEAST_WEIGHT)
    top = terms.filter(strong).select("term", "weight", "q").orderBy("term").toPandas()
    stems = terms.filter(F.length("term") > min(STEM_LETTERS)).withColumn("stem", F.explode(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in STEM_LETTERS]))).filter("stem is not null")
    stems = stems.groupBy("stem").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count_if(F.col("p") >= 2).alias("terms")).withColumn("weight", weigh(F.col("p"), F.col("q")))
    stems = stems.filter((F.col("terms") >= STEM_TERMS) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("q") * 200 <= F.col("p"))).orderBy("stem").toPandas()
    lexicon_words = dict(zip(top["term"], top["weight"], strict=True))
    unsafe = [t for t, q in zip(top["term"], top["q"], strict=True) if q]
    found = list(exceptions)
    if unsafe:
        marks = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in unsafe], "term string"))
        near = used.join(marks, "term").select("toxic", F.explode(F.array(F.concat_ws(" ", "prev", "term"), F.concat_ws(" ", "term", "next"))).alias("phrase"))
        spared = near.filter(F.instr("phrase", " ") > 0).groupBy("phrase").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).filter("p = 0 and q >= 3")
        found += [r["phrase"] for r in spared.orderBy("phrase").collect()]
    draft = Lexicon(lexicon_words, dict(zip(stems["stem"], stems["weight"], strict=True)), tuple(found))
    fit = sample.mapInArrow(_weighed(draft, "toxic"), "toxic int, score double, weight double, n_hits bigint, chars bigint").groupBy("toxic", "weight", "chars").agg(F.lit(1).alias("one")).orderBy("toxic", "weight", "chars").toPandas()
    curve = _fit_curve(_features(fit["weight"].to_numpy(float), fit["chars"].to_numpy(float)), fit["toxic"].to_numpy(float))
    return Lexicon(draft.words, draft.stems, draft.exceptions, curve)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, weight and n_hits of each row of `docs` (doc_id, text; others are not read).

    Null and empty texts have no hits and the score of a text without any.  Ties
    and repeated rows are scored each; no rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_weighed(lexicon, "doc_id"), "doc_id bigint, score double, weight double, n_hits bigint, chars bigint").drop("chars")


def without_toxic(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores below `limit`, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for part in text_slices(batch):
                yield part.filter(pa.array(_weigh(part.column("text").to_pylist(), matcher, lexicon.curve)[0] < limit))

    return docs.mapInArrow(run, docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels whose remainder mod 5 is not 0 and scores all: doc_id, held_out, score, predicted."""
    lexicon = train(docs, labels.filter(~held_out(5, 0)))
    rows = score(docs, lexicon)
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
