"""Near-duplicates, language, toxicity, quality and personal data: brute force, and odd rows."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from tidewheel.llm import langid, neardup, pii, quality, toxicity
from tidewheel.llm.components import components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: (len(x), find(i)) for i, x in sets}


def near_copies(rng, groups=25, spread=8):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, spread)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_components_match_brute_force(spark, k):
    rows = near_copies(random.Random(k))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A  b"), (1005, "b a"), (1006, "x" * 300_000 + " y z"), (1007, rows[0][1].upper())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), k).collect()}
    assert got == brute_components(rows, k)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(1200):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 4).items()}
    assert got == want


def test_texts_of_one_template_meet_by_rare_shingles(spark, monkeypatch):
    """Many texts that share 70 % and link to few others: the large buckets' way, at a bucket size of 16."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    met = []
    by_prefix = neardup._by_prefix
    monkeypatch.setattr(neardup, "_by_prefix", lambda *a: met.append(1) or by_prefix(*a))
    rng = random.Random(13)
    base = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(base + [f"u{i}_{j}" for j in range(18)])) for i in range(150)]
    for i in range(0, 150, 10):  # copies that differ from their original by a few words, also outside the template
        words = rows[i][1].split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute_components(rows, 4) and met


def test_near_duplicates_on_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "a b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, False), (7, 1, False)], key=repr)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    left = neardup.without_duplicates(docs(spark, rows))
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1]


def test_the_estimate_rejects_true_pairs_no_more_often_than_the_bands():
    equal, n = 0.8 + 0.2 / 2**neardup.BITS, neardup.HASHES
    needed = math.ceil(n * ((0.8 - neardup.MARGIN) * (1 - 2**-neardup.BITS) + 2**-neardup.BITS))
    rejected = sum(math.comb(n, i) * equal**i * (1 - equal) ** (n - i) for i in range(needed))
    assert rejected <= (1 - 0.8 ** (n // neardup.BANDS)) ** neardup.BANDS


def test_each_text_of_a_repeated_id_is_decided_on(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(1, a), (7, a), (7, b), (7, b), (8, b), (9, c), (9, a), (9, None), (10, "v w x y z z z"), (None, a)]
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.without_duplicates(docs(spark, rows)).collect()), key=repr)
    texts = [t for i, t in left if i is not None]
    assert sorted(t for t in texts if t) == sorted([a, b, c, rows[8][1]]) and (9, None) in left and (9, c) in left and (None, a) in left


def test_estimates_take_out_chance_collisions():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (200, neardup.HASHES), dtype=np.uint64)
    b = a.copy()
    change = rng.random(b.shape) < 0.3
    b[change] = rng.integers(0, 2**63, int(change.sum()), dtype=np.uint64)
    for bits in (2, 4):
        est = np.diag(neardup.estimate(neardup.pack_low_bits(a, bits), neardup.pack_low_bits(b, bits), bits))
        assert abs(est.mean() - 0.7) < 0.02


def test_connected_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}


def test_language_learns_and_names_what_has_no_letter(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàùâ"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(20)), lang, "s", 0) for i, lang in enumerate(rng.choice(list(alphabets)) for _ in range(200))]
    odd = [(900, None, "aa", None, None), (901, "", None, "s", 1), (902, "123 --- 45", "bb", "s", 1), (903, "vwx" * 50_000, None, None, None), (904, "\x00abc\x00", None, None, None), (None, "abcab", "aa", None, None)]
    got = langid.identify_held_out(docs(spark, rows + odd, DOC)).collect()
    assert len(got) == len(rows) + len(odd)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(pred[i] == lang for i, _, lang, _, _ in rows)
    assert (pred[900], pred[901], pred[902], pred[903], pred[904]) == ("und", "und", "und", "bb", "aa")
    assert all(0 <= r["score"] <= 1 for r in got) and {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in docs(spark, rows + odd, DOC).filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()}
    assert langid.identify_held_out(docs(spark, [], DOC)).count() == 0
    nothing = langid.identify_held_out(docs(spark, [(1, "abc", None, None, None)], DOC)).collect()[0]
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)


def toxic_rows(rng, n=300):
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilestuff", "vilething", "grimtalk"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_finds_folded_terms_and_spares_exceptions(spark):
    rows, labels = toxic_rows(random.Random(3))
    lexicon = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), exceptions=("grimtalk show",))
    probe = [(1, "such vilestuff here"), (2, "such V1LESTUFF! here"), (3, "such vіlеstuff here"), (4, "word1 word2 word3"), (5, "the grimtalk show word2"), (6, "mygrimtalky word2"), (7, None), (8, ""), (None, "grimtalk"), (9, "word5 " * 30_000 + "grimtalk")]
    got = {r["doc_id"]: (r["score"] >= 0.5, r["n_hits"]) for r in toxicity.score(docs(spark, probe), lexicon).collect()}
    assert {i for i, (bad, _) in got.items() if bad} >= {1, 2, 3, None} and got[9][1] == 1
    assert all(got[i][1] == 0 and not got[i][0] for i in (4, 5, 6, 7, 8))
    kept = toxicity.without_toxic(docs(spark, probe), lexicon)
    assert {4, 5, 6, 7, 8} <= {r["doc_id"] for r in kept.collect()} and kept.columns == ["doc_id", "text"]
    empty = toxicity.train(docs(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert empty.words == {} and toxicity.score(docs(spark, []), empty).count() == 0


def test_folding_keeps_places():
    for text in ("İstanbul Straße ＡＢＣ", "р0rn 1d10t", "", "Ω"):
        assert len(toxicity.fold(text)) == len(text)


def test_held_out_toxicity(spark):
    rows, labels = toxic_rows(random.Random(8), 400)
    got = {r["doc_id"]: r for r in toxicity.score_held_out(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.97


def test_quality_separates_junk_and_survives_odd_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
        rows.append((i, ". ".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, " "), (903, "x" * 200_000), (None, "a b")]
    marks = spark.createDataFrame([*labels, (901, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_held_out(docs(spark, rows), marks).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["predicted"] == q for i, q, _ in labels if got[i]["held_out"]]) > 0.97
    none = quality.score_held_out(docs(spark, rows[:2]), marks.filter("quality is null")).collect()
    assert [r["score"] for r in none] == [0.5, 0.5]
    assert quality.score_held_out(docs(spark, []), marks).count() == 0


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@-+1 2(4_é%@.") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("4" * 50_000 + "." * 50_000 + "a" * 100_000) == []


def test_personal_data_and_redaction(spark):
    rows = [(1, "é mail joe@x.org, ip 10.0.0.1"), (2, None), (3, ""), (4, "call +1 (353) 555-0764 or 999.1.1.1"), (None, "a@b.cd"), (1, "é mail joe@x.org, ip 10.0.0.1")]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert len(got) == 6
    for r in got:
        text = {1: rows[0][1], 4: rows[3][1], None: rows[4][1]}.get(r["doc_id"], "")
        want = pii.joined(brute_spans(text))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
    wide = docs(spark, [(1, rows[0][1], 29, "z")], "doc_id bigint, text string, n_chars bigint, spans string")
    out = pii.redacted(wide).collect()[0]
    assert out["text"] == "é mail [EMAIL], ip [IP]" and out["n_chars"] == len(out["text"]) and out["spans"] == "z"
    assert pii.personal_data(docs(spark, [])).count() == 0 and pii.redacted(docs(spark, [])).count() == 0


def test_redaction_covers_the_union_of_overlapping_spans():
    text = "from 10.0.0.1 4111 1111 1111 111 on"
    assert pii.redact(text, "ip:5:13,card:12:32") == "from [IP][CARD] on"
    assert pii.redact(text, "card:5:32,ip:5:13") == "from [CARD] on"
    found = next(t for i in range(10) if (t := f"from 10.0.0.1 4111 1111 1111 11{i} on") and len(pii.base_spans(t)) > 1)
    assert pii.redact(found, pii.joined(sorted(pii.base_spans(found)))) == "from [IP][CARD] on"


def test_contexts_reveal_unseen_forms(spark):
    seeds = [(i, f"word{i} please reach user{i}@mail.org soon") for i in range(12)]
    hidden = [(100, "filler please reach odd(at)mail.org soon"), (101, "nothing of that kind odd(at)mail.org here")]
    plain = [(200 + i, f"please note word{i} and more") for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, seeds + hidden + plain)).collect()}
    text = hidden[0][1]
    at = text.index("odd(")
    assert got[100] == f"email:{at}:{at + len('odd(at)mail.org')}"
    assert got[101].startswith("email:") and got[205] == ""  # a trusted form is personal data wherever it stands


def test_contexts_of_any_length_and_of_rows_without_an_id(spark):
    seeds = [(i, f"é word{i} {'x' * 130} reach user{i}@mail.org soon") for i in range(12)]
    hidden = [(100, f"ü filler {'x' * 130} reach odd(at)mail.org soon"), (None, f"other {'x' * 130} reach even(at)mail.org")]
    rows = docs(spark, seeds + hidden)
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(rows).collect()}
    for i, text in hidden:
        at = text.index("odd(") if i else text.index("even(")
        assert got[i] == f"email:{at}:{at + len(text[at:].split()[0])}"
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(rows).collect()}
    assert texts[None].endswith("reach [EMAIL]") and "[EMAIL]" in texts[100]


def test_pattern_counts_match_the_texts(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice("ab cd ef gh é".split()) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(99, None)]
    want = {}
    for _, t in rows:
        words = (t or "").split()
        for pair in zip(words, words[1:], strict=False):
            want[pair] = want.get(pair, 0) + 1
    h = {p: int(pii._pair(pii.Words(*pii.utf8(pii.pa.array([" ".join(p)]))).hash)[0]) for p in list(want)[:9]}
    got = pii._count_patterns(docs(spark, rows), spark.createDataFrame([(v,) for v in h.values()], "pattern bigint")).collect()
    assert {r["pattern"]: r["places"] for r in got} == {v: want[p] for p, v in h.items()}


def test_loose_spans_beside_many_base_spans_match_the_plain_rule():
    rng = random.Random(22)
    for _ in range(300):
        text = " ".join(rng.choice(["a@b.cd", "x(at)y.org", "10.0.0.1", "1.2.3", "+1 (353) 555-0764", "(353) 555-0764 12", "4111 1111 1111 1111"]) for _ in range(rng.randrange(8)))
        base = pii.base_spans(text)
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii._LOOSE[kind].finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base))
        assert pii.loose_spans(text, base) == want


def test_a_text_of_many_spans_takes_linear_time(spark):
    text = " ".join(f"user{i}@mail.org user{i}(at)mail.org" for i in range(100_000))
    began = time.monotonic()
    got = pii.personal_data(docs(spark, [(1, text), (2, "mail a@b.cd")])).collect()
    assert {r["n_email"] for r in got} == {100_000, 1} and time.monotonic() - began < 60


def test_language_scores_match_a_direct_naive_bayes(spark):
    rng = random.Random(31)
    def text():
        return "".join(rng.choice("abcé .,X1") for _ in range(rng.randrange(0, 30)))
    rows = [(i, text(), rng.choice(["p", "q", "r"])) for i in range(90)] + [(200, "\x00ab\x00", "p")]
    names, logp = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    def grams(t):
        chars = [" "]
        for c in t.lower():  # letters as they are, everything else one gap
            gap = not ("a" <= c <= "z" or ord(c) >= 0xAA)
            if not (gap and chars[-1] == " "):
                chars.append(" " if gap else c)
        out = []
        for n in langid.ORDERS:
            out += [tuple(chars[i : i + n]) for i in range(len(chars) - n + 1) if n > 1 or chars[i] != " "]
        return out
    def bucket(gram):
        h = np.zeros(1, np.uint64)
        for n, c in enumerate(gram, 1):
            h = langid.mix64(h * np.uint64(0x9FB21C651E98DF25) + np.uint64(ord(c)) + np.uint64(n))
        return int(h[0] >> np.uint64(64 - langid.BUCKET_BITS))
    counts = {lang: np.full(1 << langid.BUCKET_BITS, langid.SMOOTHING) for lang in names}
    for _, t, lang in rows:
        for g in grams(t):
            counts[lang][bucket(g)] += 1
    want = np.stack([np.log(c / c.sum()) for c in (counts[lang] for lang in names)], axis=1)
    assert names == ["p", "q", "r"] and np.allclose(logp, want, atol=1e-5)
    for r in langid.identify(docs(spark, [(i, t) for i, t, _ in rows]), (names, logp)).collect():
        t = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        total = np.asarray([sum(want[bucket(g), j] for g in grams(t)) for j in range(3)])
        if any(c.isalpha() for c in t):
            share = np.exp(total - total.max())
            assert r["score"] == pytest.approx(share.max() / share.sum(), abs=1e-3) and total[names.index(r["lang_pred"])] == pytest.approx(total.max(), abs=1e-3)
        else:
            assert r["lang_pred"] == "und"


def test_sampling_of_vast_tables_never_goes_to_nothing():
    for module, rows in ((langid, langid.TRAIN_ROWS), (toxicity, toxicity.TRAIN_ROWS)):
        assert int(rows / 1e14 * (1 << module.SAMPLE_BITS)) > 1e8


def test_hits_match_a_plain_search():
    rng = random.Random(32)
    lexicon = toxicity.Lexicon({"ab": 1.0, "cab": 2.0, "b": 0.5}, {"cabb": 3.0}, ("ab c", "B a"))
    matcher = toxicity.Matcher(lexicon)

    def plain(text):
        low, hits, spared = toxicity.fold(text), {}, set()
        for s in range(len(text)):
            if s and text[s - 1].isalnum():
                continue
            for terms, whole in ((lexicon.words, True), (lexicon.stems, False), (dict.fromkeys(map(toxicity.fold, lexicon.exceptions)), True)):
                for term, weight in terms.items():
                    end = s + len(term)
                    if low.startswith(term, s) and (not whole or end == len(text) or not text[end].isalnum()):
                        if weight is None:
                            spared |= set(range(s, end))
                        else:
                            hits[s] = max(weight, hits.get(s, 0.0))
        kept = [w for s, w in hits.items() if s not in spared]
        return sum(kept), len(kept)

    for _ in range(20_000):
        text = "".join(rng.choice("aAbBcC @8é") for _ in range(rng.randrange(16)))
        assert matcher.weigh(text) == plain(text), text
    many = "ab c " * 100_000 + "cab"
    began = time.monotonic()
    assert matcher.weigh(many) == (2.0, 1) and time.monotonic() - began < 10


def test_repeated_rows_and_clashing_columns_teach_once(spark):
    rows, labels = toxic_rows(random.Random(3), 120)
    schema = "doc_id bigint, text string, toxic string, term string, weight int"
    wide = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], schema)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    once = toxicity.train(wide, marks)
    assert once.words and toxicity.train(wide.union(wide).union(wide), marks) == once
    kept = toxicity.without_toxic(wide, once)
    assert kept.columns == wide.columns and 0 < kept.count() < 120


def test_quality_log_odds_match_the_density_formula():
    rng = np.random.default_rng(33)
    a = rng.standard_normal((2, 6, 6))
    cov = a @ a.transpose(0, 2, 1) + 0.3 * np.eye(6)
    means, priors, x = rng.standard_normal((2, 6)), np.asarray([0.3, 0.7]), rng.standard_normal((50, 6))
    logs = [np.log(p) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) for m, c, p in zip(means, cov, priors, strict=True)]
    assert np.allclose(quality.Discriminant(means, cov, priors).log_odds(x), logs[1] - logs[0])
    assert np.allclose(quality.inverse_lower(np.linalg.cholesky(cov[0])) @ np.linalg.cholesky(cov[0]), np.eye(6))


def test_quality_learns_the_class_moments(spark):
    rng = random.Random(34)
    rows = [(i, " ".join(rng.choice(["ab", "cdef", "GH!", "9"]) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    marks = [(i, i % 2, 0) for i in range(80)]
    model = quality.train(quality.describe(docs(spark, rows)), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    x = np.stack([quality.statistics(*quality.utf8(quality.pa.array([t])))[0] for _, t in rows])
    for c in (0, 1):
        assert np.allclose(model.means[c], x[c::2].mean(axis=0)) and model.priors[c] == 0.5
    raw = [np.cov(x[c::2].T, bias=True) for c in (0, 1)]
    pooled = (raw[0] + raw[1]) / 2
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
    d = len(pooled) + 1
    s = quality.SHRINKAGE + (1 - quality.SHRINKAGE) * d / (40 + d)
    assert np.allclose(model.covariances[0], (1 - s) * raw[0] + s * pooled)
