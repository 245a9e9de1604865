"""The prefix trie against a plain trie, and token counts against the library itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import tokens, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_trie(rows):
    """Nodes by walking every rebuilt conversation's prefixes."""

    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(donor, [])[:h] + ts[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole) == d))
    out = {}
    for prefix, cs in members.items():
        under = [q for q in members if q[: len(prefix)] == prefix]
        children = [q for q in under if len(q) == len(prefix) + 1]
        leaves = [q for q in under if not any(len(r) > len(q) and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under)
        ends = ",".join(str(c) for c in sorted(c for c, last in cs if last))
        parent = min(c for c, _ in members[prefix[:-1]]) if prefix else None
        out[min(c for c, _ in cs), len(prefix)] = (parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(df):
    got = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


ODD_ROWS = [
    (0, 2, "user", "b"),
    (0, None, None, None),
    (0, 1, "user", "a"),
    (0, 1, "user", "a"),
    (0, 1, "assistant", "a"),
    (1, 5, "user", "short"),
    (7, -3, "user", "x" * 5000),
    (7, 900, "", "𝒳é"),
    (7, 300, None, "z"),
    (-5, 1, "user", "minus"),
    (150, 0, "user", "without a donor"),
    (None, 0, "user", "nobody"),
    (None, None, None, None),
    (9_000_000_000, 0, "us", "er"),
    (9_000_000_000, 0, "user", ""),
]


def test_trie_of_odd_rows(spark):
    rows = spark.createDataFrame(ODD_ROWS, SCHEMA)
    clashing = rows.withColumns({c: F.lit("taken") for c in ("conv", "pos", "name", "b", "len", "rep", "depth", "key", "digest", "run")})
    want = plain_trie(ODD_ROWS)
    assert found_trie(trie.prefix_trie(rows)) == want
    assert found_trie(trie.prefix_trie(clashing)) == want


def test_trie_of_many_copies_and_a_long_conversation(spark):
    dice = random.Random(3)
    rows = [(300, i, "user", dice.choice("ab")) for i in range(70)] + [(399, i, "user", "same") for i in range(600)]
    for c in range(60):
        n = dice.randrange(1, 9)
        rows += [(c, i, "user", "hot" if c % 3 == 0 else dice.choice("abc")) for i in range(n)]
    dice.shuffle(rows)
    want = plain_trie(rows)
    assert max(d for _, d in want) >= 595
    assert found_trie(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == want


def test_trie_with_large_nodes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trie, "LARGE_LEAST", 2)
    monkeypatch.setattr(trie, "LARGE_NODES", 12)
    dice = random.Random(6)
    rows = [(c, i, "user", "hot" if i == 0 and c % 3 else dice.choice("ab")) for c in range(1, 90) for i in range(dice.randrange(1, 6))]
    assert found_trie(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_trie_joins_ends_beyond_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    rows = [(c, i, "user", "copy") for c in range(0, 3000, 100) for i in range(2)]
    assert found_trie(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def library_counts(texts):
    library = Tokenizer.from_file(BYTE_BPE)
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


ODD_TEXTS = [
    "",
    " ",
    "  \n\t x  y z　 ",
    "it's we'll I'D they've 'tis ''s",
    "a<|endoftext|>b <|endoftext|><|endoftext|> c<|endoftext",
    "12345 6.7 ٣٤ Ⅻ ²³",
    "naïve ﬁ ſ 𝒳𝒴 한국어 日本語テキスト ไทย é‍",
    "\x00\x1c\x1d\x85  ᠎﻿",
    "👩‍👩‍👧‍👦🏳️‍🌈",
    "࢏ ՘ \U00040000 \U0010ffff",
    "a" * 70_000,
    "ab " * 40_000 + "  end",
    " " * 5_000 + "x",
    "!" * 3_000,
]


def test_token_counts_equal_the_library(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD_TEXTS)] + [(3, None, None, None), (None, "it's", None, None), (1, " ", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, known string")
    got = sorted(tokens.token_counts(docs, BYTE_BPE).collect(), key=repr)
    texts = [r[1] or "" for r in rows]
    want = [(r[0], len(t.encode()), n, n > 512) for r, t, n in zip(rows, texts, library_counts(texts), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(docs.limit(0), BYTE_BPE).collect() == []


def test_token_counts_forget_in_time(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHARS", 5)
    monkeypatch.setattr(tokens, "SLICE", 4)
    count = tokens.Counter(*tokens.proven(BYTE_BPE))
    texts = ["qzxv " * 30 + t for t in ODD_TEXTS[:9]]
    assert [count(t) for t in texts] == library_counts(texts)


def test_every_proven_string_is_one_token():
    _, single, *_ = tokens.proven(BYTE_BPE)
    assert len(single) > 40_000 and set(library_counts(sorted(single))) == {1}


def test_only_byte_level_files_are_taken():
    with pytest.raises(ValueError):
        tokens.proven(public_tokenizers.path("word_bpe_49k.json"))
