"""Text quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.langid import held_out
from tidewheel.llm.session import cut
from tidewheel.llm.textkernel import Words, text_slices, utf8

FEATURES = ("words", "word_bytes", "word_spread", "distinct", "repeated_shingles", "capitals", "digits", "signs", "signed_words", "ends", "line_words", "repeated_lines", "short_words", "stops_per_line")
SHRINKAGE = 0.05

_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 capital, 3 digit, 4 sign, 5 sentence mark
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 4
for _c in b",.;:'-":
    _KIND[_c] = 5


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text: one row of FEATURES, all zero for a text without words."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    w = Words(data, offsets)
    some = w.count > 0
    if not some.any():
        return out
    count = np.maximum(w.count, 1)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[mask], minlength=n).astype(float)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.text, weights=values, minlength=n)

    letters = per_text((kind == 1) | (kind == 2))
    size = (w.end - w.start).astype(float)
    mean = per_word(size) / count
    spread = np.sqrt(np.maximum(per_word(size**2) / count - mean**2, 0))
    order = np.lexsort((w.hash, w.text))
    h, t = w.hash[order], w.text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[new], minlength=n)
    st, sh = w.shingles(3)
    order = np.lexsort((sh, st))
    sh, st = sh[order], st[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (st[1:] != st[:-1])
    shingles, own = np.bincount(st, minlength=n), np.bincount(st[new], minlength=n)
    last = kind[w.end - 1]
    signed = per_word((last == 4).astype(float)) / count
    stops = per_text(data == 46)
    breaks = data == 10
    lines = per_text(breaks) + 1
    # a word's line: line breaks before it; a line's hash: the sum of its words'
    broken = np.cumsum(breaks)
    line = broken[w.start] + w.text  # differs between texts too
    edge = np.ones(len(line), dtype=bool)
    edge[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(edge)
    line_hash = np.add.reduceat(w.hash, first)
    line_text = w.text[first]
    order = np.lexsort((line_hash, line_text))
    lh, lt = line_hash[order], line_text[order]
    again = np.zeros(len(lh), dtype=bool)
    again[1:] = (lh[1:] == lh[:-1]) & (lt[1:] == lt[:-1])
    filled = np.maximum(np.bincount(lt, minlength=n), 1)
    out[:, 0] = np.log1p(w.count)
    out[:, 1] = np.log(mean + 1)
    out[:, 2] = np.log(spread + 0.5)
    out[:, 3] = np.sqrt(distinct / count)
    out[:, 4] = np.sqrt(1 - own / np.maximum(shingles, 1))
    out[:, 5] = np.sqrt(per_text(kind == 2) / np.maximum(letters, 1))
    out[:, 6] = np.sqrt(per_text(kind == 3) / count)
    out[:, 7] = np.sqrt(per_text(kind == 4) / count)
    out[:, 8] = np.sqrt(signed)
    out[:, 9] = np.sqrt(stops / count)
    out[:, 10] = np.log1p(w.count / lines)
    out[:, 11] = np.sqrt(np.bincount(lt[again], minlength=n) / filled)
    out[:, 12] = np.sqrt(per_word((size <= 3).astype(float)) / count)
    out[:, 13] = np.log1p(stops / lines)
    out[~some] = 0
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            x = statistics(*utf8(part.column("text")))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), arrays], names=["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics `x` of each whole text (null: as empty)."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_describe, "doc_id bigint, x array<double>")


def inverse_lower(factor: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, by forward substitution."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = -(factor[i, :i] @ out[:i])
        out[i, i] += 1
        out[i] /= factor[i, i]
    return out


@dataclass
class Discriminant:
    """Class means, priors and the Cholesky factors of the shrunk class covariances; factors and their inverses are computed once."""

    means: np.ndarray
    covariances: np.ndarray
    priors: np.ndarray
    factors: list[np.ndarray] = field(init=False)
    whiteners: list[np.ndarray] = field(init=False)
    log_dets: list[float] = field(init=False)

    def __post_init__(self):
        self.factors = [np.linalg.cholesky(c) for c in self.covariances]
        self.whiteners = [inverse_lower(f) for f in self.factors]
        self.log_dets = [2 * float(np.log(np.diag(f)).sum()) for f in self.factors]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, whitener, det, prior in zip(self.means, self.whiteners, self.log_dets, self.priors, strict=True):
            z = (x - mean) @ whitener.T
            logs.append(np.log(prior) - 0.5 * (det + (z**2).sum(axis=1)))
        return logs[1] - logs[0]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
        y = np.asarray(batch.column("y"))
        for c in np.unique(y):
            rows = np.concatenate([np.ones((int((y == c).sum()), 1)), x[y == c]], axis=1)
            total[int(c)] = total.get(int(c), 0) + rows.T @ rows
    for c, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["y", "i", "v"])


def train(described: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """Fits on every row of `described` whose doc_id `labels` (doc_id, quality 0/1) has; None unless both classes have rows.

    A class covariance is shrunk towards the pooled covariance and that towards its
    diagonal.  Rows with nulls teach nothing; a doc_id labelled twice takes its
    larger label.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    summed = described.join(marked, "doc_id").select("y", "x").mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    table = summed.orderBy("y", "i").toPandas()
    if set(table["y"]) != {0, 1}:
        return None
    d = len(FEATURES) + 1
    means, raw, sizes = [], [], []
    for c in (0, 1):
        m = table.loc[table["y"] == c, "v"].to_numpy().reshape(d, d)
        n = m[0, 0]
        mu = m[0, 1:] / n
        means.append(mu)
        sizes.append(n)
        raw.append(m[1:, 1:] / n - np.outer(mu, mu))
    sizes = np.asarray(sizes)
    pooled = (sizes[0] * raw[0] + sizes[1] * raw[1]) / sizes.sum()
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d - 1)
    weight = shrinkage + (1 - shrinkage) * d / (sizes + d)
    covariances = np.stack([(1 - s) * c + s * pooled for s, c in zip(weight, raw, strict=True)])
    return Discriminant(np.stack(means), covariances, sizes / sizes.sum())


def score(described: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and score of each row of `described`; without a model every score is 0.5.

    Null and empty texts are scored from all-zero statistics, repeated rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                odds = model.log_odds(x) if model else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))))], names=["doc_id", "score"])

    return described.mapInArrow(run, "doc_id bigint, score double")


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels whose remainder mod 5 is not 0 and scores all: doc_id, held_out, score, predicted."""
    described = cut(describe(docs))
    model = train(described, labels.filter(~held_out(5, 0)))
    rows = score(described, model)
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
