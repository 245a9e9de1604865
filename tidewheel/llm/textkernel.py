"""Vectorised text primitives over Arrow batches.

A batch's texts are one UTF-8 buffer; words, lower-casing and shingle hashes are
numpy passes over that buffer, so the cost per byte is a few nanoseconds and no
Python loop runs over words.  Batches are cut into slices of bounded bytes (a
single longer text is a slice of its own), which bounds the worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_pow = _powers(_BASE, 1 << 16)
_inv = _powers(_BASE_INV, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if n > len(_pow):
        if n > 8 * SLICE_BYTES:  # a giant text must not leave giant tables behind
            return _powers(_BASE, n), _powers(_BASE_INV, n)
        size = max(n, 2 * len(_pow))
        _pow, _inv = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _pow[:n], _inv[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch so that the texts of a slice hold at most `limit` bytes, or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    if len(col) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or len(col) == 0 or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words (runs without ASCII white space) of a slice: where they start and end,
    which text they belong to, and a 64-bit hash of their A-Z-lowered bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.n_texts = len(offsets) - 1
        edges = np.zeros(n + 1, dtype=bool)
        if n:
            word = ~_SPACE[data]
            edges[0] = word[0]
            edges[1:n] = word[1:] & ~word[:-1]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            edges[cuts] = word[cuts]
            self.start = np.flatnonzero(edges)
            last = np.zeros(n, dtype=bool)
            last[-1] = word[-1]
            last[:-1] = word[:-1] & ~word[1:]
            last[cuts - 1] = word[cuts - 1]
            self.end = np.flatnonzero(last) + 1
            power, inverse = _tables(n)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[_LOWER[data]] * power, dtype=np.uint64, out=total[1:])
            self.hash = mix64((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets[:-1])  # of each text
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.text = np.repeat(np.arange(self.n_texts), self.count)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every k-word shingle, repeats included; a text of 1 to k - 1 words has its whole sequence as one."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        parts_t, parts_h = [], []
        if n >= k:
            h = self.hash[: n - k + 1].copy()
            for i in range(1, k):
                h = mix64(h * np.uint64(0x9FB21C651E98DF25) + self.hash[i : n - k + 1 + i])
            keep = self.text[: n - k + 1] == self.text[k - 1 :]
            parts_t.append(self.text[: n - k + 1][keep])
            parts_h.append(h[keep])
        for length in range(1, k):
            texts = np.flatnonzero(self.count == length)
            if len(texts):
                at = self.first[texts]
                h = self.hash[at] + np.uint64(length)
                for i in range(1, length):
                    h = mix64(h * np.uint64(0x9FB21C651E98DF25) + self.hash[at + i])
                parts_t.append(texts)
                parts_h.append(mix64(h))
        return np.concatenate(parts_t), np.concatenate(parts_h)

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes, text after text, and n + 1 offsets."""
        text, h = self.shingles(k)
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        text, h = text[new], h[new]
        return h, np.searchsorted(text, np.arange(self.n_texts + 1))
