"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.textkernel import mix64, text_slices

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
TRAIN_ROWS = 40_000  # at most about so many labelled rows are learned from, chosen by a hash of their text
SMOOTHING = 0.5
SAMPLE_BITS = 60  # of the hash that samples


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram: lower-cased letters, everything else a single gap, one gap before each text, n-grams within a text."""

    def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join("\x00" + t.lower() for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        return codes, np.flatnonzero(codes == 0)

    codes, bounds = coded(texts)
    if len(bounds) != len(texts):  # a text holds the separator itself
        codes, bounds = coded([t.replace("\x00", " ") for t in texts])
    text = np.zeros(len(codes), dtype=np.int64)
    text[bounds] = 1
    text = np.cumsum(text) - 1
    gap = (codes < 0x61) | ((codes > 0x7A) & (codes < 0xAA))
    norm = np.where(gap, np.uint32(32), codes).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (codes[1:] != 0))
    norm, text = norm[keep], text[keep]
    shift = np.uint64(64 - BUCKET_BITS)
    parts_t, parts_b = [], []
    h = np.zeros(len(norm), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(norm) - n + 1
        if m <= 0:
            break
        h = mix64(h[:m] * np.uint64(0x9FB21C651E98DF25) + norm[n - 1 :] + np.uint64(n))
        if n in ORDERS:
            ok = text[:m] == text[n - 1 :]
            if n == 1:
                ok &= norm != 32
            parts_t.append(text[:m][ok])
            parts_b.append((h[ok] >> shift).astype(np.int64))
    return np.concatenate(parts_t or [text[:0]]), np.concatenate(parts_b or [text[:0]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in text_slices(batch):
            langs = part.column("lang").to_pylist()
            text, bucket = _grams([t or "" for t in part.column("text").to_pylist()])
            names = sorted(set(langs))
            code = np.asarray([names.index(x) for x in langs])
            dense = np.bincount((code[text] << BUCKET_BITS) + bucket, minlength=len(names) << BUCKET_BITS).reshape(len(names), -1)
            for name, row in zip(names, dense, strict=True):
                total[name] = total[name] + row if name in total else row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Language names and the log-probability matrix, bucket by language; priors are even.

    Learns from the non-null `text` and `lang` of `labelled`, all of it up to about
    `rows` rows and else a sample of that size by a hash of the text.  What comes to
    the driver is one count for each language and bucket.
    """
    labelled = labelled.select("text", "lang").filter("lang is not null and text is not null")
    n = labelled.count()
    if n > rows:
        labelled = labelled.filter(F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 64 - SAMPLE_BITS) < int(rows / n * (1 << SAMPLE_BITS)))
    counted = labelled.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    names = sorted(table["lang"].unique())
    counts = np.full((1 << BUCKET_BITS, len(names)), SMOOTHING)
    counts[table["bucket"], [names.index(x) for x in table["lang"]]] += table["n"]
    logp = np.log(counts / counts.sum(axis=0))
    return names, logp.astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """`docs` (doc_id, text; others are not read) as doc_id, lang_pred, score.

    lang_pred is the most likely learned language of the whole text and score its
    posterior probability under even priors.  A null text, one without a letter,
    and every text if nothing was learned, is `und` with score 0.  Ties go to the
    first name by code point.  Repeated rows are scored each; no rows give no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = shared.value
        for batch in batches:
            for part in text_slices(batch):
                n = part.num_rows
                text, bucket = _grams([t or "" for t in part.column("text").to_pylist()])
                total = np.zeros((n, max(1, len(names))))
                for j in range(len(names)):
                    total[:, j] = np.bincount(text, weights=logp[:, j][bucket], minlength=n)
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                known = np.asarray(part.column("lettered")).astype(bool) if names else np.zeros(n, dtype=bool)
                pred = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    lettered: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), lettered.cast("int").alias("lettered"))
    return rows.mapInArrow(score, "doc_id bigint, lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text has this remainder (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose remainder mod 3 is not 1 and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(3, 1)))
    return identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
