"""Exact token counts: whole-token shortcut over proven vocabulary strings, merges for the rest only.

A byte-level BPE first splits a text into pre-tokens and then merges bytes within
each.  Offline, before the scan, the library itself encodes each string of its
vocabulary; those that come out as their own single token are proven.  In the scan a
proven pre-token counts one without any merging; each other one is merged once a
worker (a bounded memo).  The split is this module's pattern, whose character classes
are proven too: code points are split by the library and by the pattern, and a text with one
on which they differ goes whole to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: how byte-level BPE vocabularies of this kind split a text into pre-tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 1 << 16  # pre-tokens that are held at once
MEMO_CHARS = 1 << 22  # characters of merged pre-tokens that a worker remembers
BLOCK = 1 << 12  # code points that are proven at once
PROVEN_BELOW = 0x40000  # the planes above hold no letters; their code points are left to the library unproven
LIMIT = 512


def _disagreeing(tokenizer: Tokenizer, split: regex.Pattern, points: list[int]) -> set[int]:
    """The code points around which the library and the pattern split differently: one line of text shows the class of each."""
    lines = [f"a{chr(c)}1{chr(c)}!{chr(c)}a\n" for c in points]
    text, width = "".join(lines), len(lines[0])
    ends = {end for _, (_, end) in tokenizer.pre_tokenizer.pre_tokenize_str(text)} ^ {m.end() for m in split.finditer(text)}
    return {points[(end - 1) // width] for end in ends}


@lru_cache(maxsize=4)
def proven(path: str) -> tuple[str, frozenset[str], tuple[str, ...], frozenset[str]]:
    """Of a byte-level BPE file: its text, the strings that encode alone as one token, and the special strings and characters that only the library may split.

    All are bounded by the vocabulary and the code points there are.
    """
    source = Path(path).read_text(encoding="utf-8")
    tokenizer = Tokenizer.from_str(source)
    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space or type(tokenizer.model).__name__ != "BPE":
        raise ValueError(f"{path} is not a byte-level BPE without a normalizer and a leading space")
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    alone = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    single = frozenset(s for i, s, e in zip(ids, strings, alone, strict=True) if e.ids == [i])
    points = [c for c in range(PROVEN_BELOW) if not 0xD800 <= c < 0xE000]
    split = regex.compile(SPLIT)
    odd = {c for k in range(0, len(points), BLOCK) for c in _disagreeing(tokenizer, split, points[k : k + BLOCK])}
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return source, single, special, frozenset(map(chr, odd))


def _pieces(split: regex.Pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= SLICE:
        yield split.findall(text)
        return
    found = split.finditer(text)
    while part := [m[0] for m in islice(found, SLICE)]:
        yield part


class Counter:
    """Token counts of texts in one worker; equal to the length of the library's ids of the whole text."""

    def __init__(self, source: str, single: frozenset[str], special: tuple[str, ...], odd: frozenset[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task keeps to its core
        self.tokenizer, self.single = Tokenizer.from_str(source), single
        self.split, self.special, self.odd = regex.compile(SPLIT), special, odd
        self._forget()

    def _forget(self) -> None:
        self.known, self.stored = dict.fromkeys(self.single, 1), 0

    def _only_whole(self, text: str) -> bool:
        chars = set(text)
        return not self.odd.isdisjoint(chars) or max(chars, default="") >= chr(PROVEN_BELOW) or any(s in text for s in self.special)

    def __call__(self, text: str) -> int:
        if self._only_whole(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        total = 0
        for pieces in _pieces(self.split, text):
            rest = [p for p in set(pieces) if p not in self.known]
            self.known.update(zip(rest, map(len, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
            total += sum(map(self.known.__getitem__, pieces))
            self.stored += sum(map(len, rest))
            if self.stored > MEMO_CHARS:
                self._forget()
        return total


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """`docs` (doc_id, text; others are not read) as doc_id, n_bytes, n_tokens, over_limit.

    Tokens are those of the library for the file `path` on the whole text, without
    added begin or end tokens; a special string inside a text is its one special token,
    the library's default.  A null or empty text has no bytes and no tokens.  Each row
    is counted by itself: repeated rows and null ids stay as they are, no rows give no
    rows.  Nothing is shuffled; a text of any length is split a slice at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proven(path))

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counter(*shared.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
