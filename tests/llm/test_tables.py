"""Extraction, vectors, mixing, decontamination, secrets and the pipeline: brute force, SQL, and odd rows."""

import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import decontaminate, htmltext, mixing, queries, secrets, vectors
from tidewheel.llm.session import cut

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def main_text(page):
    return htmltext.text_at(*htmltext.parse(page), None) if page else ""


def test_extraction_leaves_out_what_is_not_the_article():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We bake</div>
    <article><h1>Title &amp; more</h1><p>One <b>bold</b>,<br>two&nbsp; three.<p>Four &lt;x&gt; &#233;.</p><ul><li>a<li>b</ul>
    <form>Name <input></form><aside>Side</aside><div class="share">Tweet</div></article>
    <section class="comments"><p>I agree, at very great length, with each and every word, yes, really.</p></section><footer>End</footer></body>"""
    assert main_text(page) == "Title & more\nOne bold, two three.\nFour <x> é.\na\nb"
    assert main_text("<p>a < b & c</p>") == "a < b & c"
    assert main_text("<div><p>unclosed <b>tags") == "unclosed tags"
    assert main_text('<div class="entry"><h2 class="section-header">Part</h2><p>Body, with words.</p><ol class="commentlist"><li>I think so</ol><div class="adsbygoogle">x</div><div class="siteFooter">y</div></div>') == "Part\nBody, with words."
    for odd in (None, "", "<", "<!--", "<script>", "</p></div>", "<a href='", "plain words"):
        assert isinstance(main_text(odd), str)
    assert main_text("plain words") == "plain words"
    assert len(main_text("<article>" + "<p>word</p>" * 50_000 + "</article>")) == 5 * 50_000 - 1


def test_extraction_keeps_headings_leads_and_sections_of_pages_in_divs():
    many = "<p>" + "Some words of the long text, and more. " * 60 + "</p>"
    some = "<p>" + "Other words of the next part, and more. " * 20 + "</p>"

    def plain(*parts):
        return "\n".join(p.replace("<p>", "").replace("</p>", "").strip() for p in parts)

    for text in (many, some, "<p>Few, words.</p>"):
        page = f"<body><div class=menu>m</div><div class=post><h1>Title</h1><p>Lead.</p><div class=body>{text}</div></div><div class=footer>f</div></body>"
        assert main_text(page) == plain("Title", "Lead.", text)
        deep = f"<body><div class=post><h1>Title</h1><div><p>Lead.</p><div><div><div><div class=body>{text}</div></div><p>By me</p></div></div></div></body>"
        assert main_text(deep) == plain("Title", "Lead.", text, "By me")
        assert main_text(f"<body><section>{many}</section><section>{text}</section></body>") == plain(many, text)
        assert main_text(f"<body><div class=one>{text}</div><div class=two>{many}</div></body>") == plain(text, many)
        links = "<ul>" + "<li><a href=/>Elsewhere</a>" * 5 + "</ul>"
        assert main_text(f"<body>{links}<div class=post><h1>Title</h1><div>{text}</div></div></body>") == plain("Title", text)
        assert main_text(f"<main><h1>Title</h1><article>{text}</article></main>") == plain("Title", text)
        assert main_text(f"<main><article>{many}</article><article>{text}</article></main>") == plain(many, text)
    assert main_text(f"<body><div>Unnamed, notice.</div><article><h1>Title</h1><div>{many}</div></article></body>") == plain("Title", many)


def test_deep_and_wide_pages_take_linear_time():
    began = time.monotonic()
    n = 100_000
    assert main_text("<div>" * n + "<p>Some words, here.</p>" + "</div>" * n) == "Some words, here."
    assert main_text("<div class='a b c'><p>x, y.</p>" * n).count("x, y.") == n
    assert main_text("<ul><li><b class=ad>" * (n // 2) + "y" + "</i></b></li></ul>" * (n // 2)) == ""
    wide = "<main>" + "".join(f"<article><p>Text {i}, and more.</p></article>" for i in range(n // 2)) + "</main>"
    nodes, blocks = htmltext.parse(wide)
    path = next(x.path for x in nodes if x.tag == "article")
    assert htmltext.text_at(nodes, blocks, path) == main_text(wide) and len(blocks) == n // 2
    main_text("<a href='" * n + "</p>" * n)
    assert time.monotonic() - began < 60


def test_steps_keep_all_class_names():
    page = "<div class='a b c d {}'><p>Text, here.</p></div>"
    assert htmltext.parse(page.format("e"))[0][1].path != htmltext.parse(page.format("f"))[0][1].path
    assert htmltext.parse(page.format("e7"))[0][1].path == htmltext.parse(page.format("e12"))[0][1].path


def test_extraction_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "https://h.org", "<p>Text.</p>", "x", "y", 3)], "page_id bigint, url string, html string, path string, host string, text int")
    assert [tuple(r) for r in htmltext.extract(rows).collect()] == [(1, "https://h.org", "Text.", 5)]


@there
def test_extraction_of_the_pages_table_against_a_plain_parser(spark):
    """All pages of the table declare an article; a plain reading of it without the named parts is the yardstick."""
    from html.parser import HTMLParser

    void = set("area base br col embed hr img input link meta source track wbr".split())
    block = set("p div li ul ol h1 h2 h3 h4 h5 h6 blockquote pre section article table tr td th figure figcaption dl dt dd".split())

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.lines = [], [""]

        def handle_starttag(self, tag, attrs):
            if tag in block:
                self.lines.append("")
            if tag == "br":
                self.lines[-1] += " "
            if tag not in void:
                self.stack.append((tag, dict(attrs)))

        def handle_endtag(self, tag):
            while any(t == tag for t, _ in self.stack) and self.stack.pop()[0] != tag:
                pass
            if tag in block:
                self.lines.append("")

        def handle_data(self, data):
            tags = [t for t, _ in self.stack]
            names = " ".join(str(a.get("class", "")) + " " + str(a.get("id", "")) for _, a in self.stack[tags.index("article") + 1 :]) if "article" in tags else ""
            if "article" in tags and not {"nav", "aside", "footer", "form", "script", "style", "header"} & set(tags[tags.index("article") :]) and not re.search(r"comment|share|related|\bad\b|ads|promo|newsletter|notice|cookie", names):
                self.lines[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    shared = ours = theirs = 0
    for r in pages.collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        a, b = Counter((got[r["page_id"]] or "").split()), Counter(" ".join(plain.lines).split())
        shared, ours, theirs = shared + sum((a & b).values()), ours + sum(a.values()), theirs + sum(b.values())
    assert shared / ours > 0.98 and shared / theirs > 0.98, (shared / ours, shared / theirs)


def test_a_host_path_does_not_drop_a_lead(spark):
    page = "<body><div class=post>{}<div class=body><p>" + "Some words, and more. " * 30 + "</p></div></div></body>"
    rows = [(i, "https://h.org/a", page.format("")) for i in range(9)] + [(9, "https://h.org/b", page.format("<h1>Title</h1>"))]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "Title\n" + got[0] and got[0].startswith("Some words")


LONG = "The long article goes on, and on. " * 40


def test_a_host_path_does_not_replace_an_article(spark):
    """A page whose article stands elsewhere than on its host's other pages keeps it; one with a short declared article gains nothing."""
    usual = [(i, "http://h.org/a", f"<div class=post><p>{LONG}{i}</p></div>") for i in range(4)]
    odd = (4, "http://h.org/b", f"<div class=post><p>One sentence leads.</p></div><div class=entry><p>{LONG}4</p></div>")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame([*usual, odd], "page_id bigint, url string, html string")).collect()}
    assert got[4] == f"One sentence leads.\n{(LONG + '4').strip()}" and all(got[i] == f"{LONG}{i}" for i in range(4))
    declared = [(i, "http://g.org/a", f"<article><p>{LONG}{i}</p></article><div class=feed><p>Short.</p></div>") for i in range(4)]
    short = (4, "http://g.org/b", f"<article><p>Brief news.</p></article><div class=feed><p>{LONG}</p></div>")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame([*declared, short], "page_id bigint, url string, html string")).collect()}
    assert got[4] == "Brief news."


def test_words_of_two_meanings_drop_no_part_of_an_article():
    body = "<article><h1>Codes</h1><p>Before it.</p>{}<p>After it.</p></article>"
    for part in ("<div class=promo-code>Say TIDE at the desk.</div>", "<div class=overlay-map>Say TIDE at the desk.</div>", "<p class=related>Say TIDE at the desk.</p>", "<div id=noticeOfLaunch>Say TIDE at the desk.</div>"):
        assert htmltext.text_at(*htmltext.parse(body.format(part)), None) == "Codes\nBefore it.\nSay TIDE at the desk.\nAfter it."
        assert "TIDE" not in htmltext.text_at(*htmltext.parse(f"<article><p>{LONG}</p></article>{part}"), None)
    for part in ("<div class=related><a href=x>Other news</a></div>", "<div class=promo>Buy it.</div>", "<div class=comment-list>I disagree.</div>", "<div class='ad-slot top'>Buy it.</div>", "<ul class='related-comments'><li>No.</ul>", "<p hidden>Not shown.</p>"):
        assert htmltext.text_at(*htmltext.parse(body.format(part)), None) == "Codes\nBefore it.\nAfter it."


def test_hosts_agree_on_a_path(spark):
    usual = "<body><div class='menu'>m</div><div class='post-{0}'><p>Long text number {0}, with commas, and more words.</p></div><div class='tail'><p>{1}</p></div></body>"
    rows = [(i, "https://h.org/a", usual.format(i, "x")) for i in range(9)] + [(20, "https://h.org/b", usual.format(20, "A tail, that, is longer, than, the post, here, in, this, page. " * 4))]
    rows += [(30, None, None), (31, "no host", ""), (32, "https://other.org", "<p>Own text.</p>"), (20, "https://h.org/b", "<p>again</p>")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    assert (20, "Long text number 20, with commas, and more words.", 49) in got
    assert {(30, "", 0), (31, "", 0), (32, "Own text.", 9), (20, "again", 5)} <= set(got) and len(got) == len(rows)
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_vectors_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(3000)]
    odd = [(100_000, None), (100_100, [0.0] * 16), (100_200, [float("nan")] * 16), (100_300, [None] + [1.0] * 15), (100_400, []), (None, [1.0] * 16), (100_500, [float("inf")] * 16), (7, [float(v) for v in x[8]])]
    got = vectors.nearest(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")).collect()
    ids = np.asarray([i for i, _ in rows] + [7])
    all_x = np.concatenate([x, x[8:9]]).astype(float)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, rows_q in found.items():
        d = np.sqrt(((all_x - all_x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = {int(ids[i]) for i in np.lexsort((ids, d))[:10]}
        rows_q.sort()
        assert [r for r, _, _ in rows_q] == list(range(1, 11)) and [s for _, _, s in rows_q] == sorted(s for _, _, s in rows_q)
        assert all(any(abs(d[j] - s) < 1e-12 for j in np.flatnonzero(ids == v)) for _, v, s in rows_q)
        hits += len(best & {v for _, v, _ in rows_q})
    assert hits / (10 * len(found)) >= 0.9
    few = vectors.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 1), (2, 2)]
    assert vectors.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_vectors_are_exact_within_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2400, 16))
    x[:600] = x[0]
    x[600:1200] = x[600] + 1e-4 * rng.standard_normal((600, 16))
    ids = rng.permutation(2400)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1), modulus=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 2400, 20))
    for q, near in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [v for v, _ in near] == ids[best].tolist()
        assert np.allclose([s for _, s in near], d[best], rtol=1e-12, atol=0)


def brute_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[ids == ids[q]] = np.inf
    return ids[np.lexsort((ids, d))[:k]].tolist()


def test_a_repeated_query_is_asked_once(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = vectors.nearest(spark.createDataFrame([*rows, rows[0], rows[0], (100, rows[3][1])], "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in got if r["query_id"] == 0] == list(range(1, 11)) and len(got) == 30
    assert len({r["vec_id"] for r in got if r["query_id"] == 0}) == 10 or any(r["vec_id"] == 100 for r in got)
    clash = spark.createDataFrame([(0, [1.0, 0.0], 5, "x"), (1, [1.0, 1.0], 6, "y")], "vec_id bigint, embedding array<double>, list int, code string")
    assert [tuple(r) for r in vectors.nearest(clash).collect()] == [(0, 1, 1, 1.0)]


@pytest.mark.parametrize("spread", [None, 0.3])
def test_lists_keep_the_recall(spark, monkeypatch, spread):
    """40 lists and several passes: random vectors, and clusters with a hot group of copies."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERIES_A_PASS", 20)
    monkeypatch.setattr(vectors, "PASSES_A_TABLE", 2)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 16))
    if spread:
        x = rng.standard_normal((60, 16))[rng.integers(0, 60, 4000)] + spread * x
        x[:1300] = x[0]
    ids = rng.permutation(4000)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {int(ids[q]): brute_nearest(ids, x, q) for q in np.flatnonzero(ids % 100 == 0)}
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.95


@there
def test_recall_on_the_embeddings_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], dtype=float)
    got = {}
    for r in vectors.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {int(ids[q]): brute_nearest(ids, x, q) for q in np.flatnonzero(ids % 100 == 0)}


def test_score_aware_coding_lowers_the_parallel_residual():
    x = np.random.default_rng(1).standard_normal((2000, 16))
    book = vectors.fit(x)

    def parallel(codes):
        r = x - np.stack([book.centroids[j][codes[:, j]] for j in range(8)], axis=1).reshape(len(x), -1)
        return np.mean(((r * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2)

    plain = book.encode(x, sweeps=0)
    assert parallel(book.encode(x)) < parallel(plain)


def same(frame, con, sql):
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(frame.columns)
    got = sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)


@there
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    same(queries.QUERIES[name](spark, DATA), con, queries.ORACLE_SQL[name])


def odd_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", rng.choice(["b", "a", "ä", None, "", "Z"]), 1) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "empty", 0), (1002, "x " * 20_000, "en", "big", 1), (None, "a b", None, "b", None), (None, "c", None, "b", None), (2000, "dup dup", "en", "b", 7), (2000, "dup dup", "en", "b", 7)]
    return spark.createDataFrame(rows, DOC)


def test_mixing_odd_rows_against_sql_and_targets(spark):
    docs = odd_documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = mixing.mix(docs)
    same(got, con, mixing.ORACLE_SQL)
    rows = got.join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and sorted(got.collect(), key=repr) == sorted(mixing.mix(docs.repartition(5)).collect(), key=repr)
    targets = {(r["source"], r["target"], r["source_size"]) for r in rows}
    assert sum(t for _, t, _ in targets) == pytest.approx(1.5 * sum(s for _, _, s in targets))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "size", "n_chars": "copies"})
    out = mixing.take(clash)
    assert out.columns == ["doc_id", "text", "size", "source", "copies"] and out.count() == mixing.take(docs).count()


def test_mixing_splits_rows_without_an_id_and_equal_rows(spark):
    """100 rows of one source and no id: different texts, and equal rows; one target lies within them."""
    for texts in ([f"a b c d w{i}" for i in range(100)], ["a b c d e"] * 100):
        rows = [(None, t, "en", "only", 1) for t in texts]
        got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
        assert {(r["size"], r["target"]) for r in got} == {(5, 750.0)} and len(got) == 100
        assert sum(r["taken"] for r in got) == 750 and {r["taken"] for r in got} == {5, 10}
        out = mixing.take(spark.createDataFrame(rows, DOC)).collect()
        assert len(out) == 100 and sum(r["copies"] for r in out) == 150 and sorted(r["text"] for r in out) == sorted(texts)
    rows = [(7, "a b", "en", "one", i % 3) for i in range(60)] + [(None, "a b", None, None, None)] * 30
    df = spark.createDataFrame(rows, DOC)
    got = mixing.mix(df)
    for source, size in ((7, 120), (None, 60)):
        own = [r for r in got.collect() if r["doc_id"] == source]
        assert own[0]["source_size"] == size and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and max(r["taken"] for r in own) <= 4
    assert sorted(got.collect(), key=repr) == sorted(mixing.mix(df.repartition(7)).collect(), key=repr)
    assert sum(r["copies"] * 2 for r in mixing.take(df).collect()) == sum(r["taken"] for r in got.collect())


def test_containment_matches_brute_force_on_odd_rows(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for i in range(30)] + [(40, None), (41, ""), (None, "q w e r t"), (42, "one two")]
    docs = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 400))]
        if i % 3 == 0:
            quote = (items[rng.randrange(30)][1]).split()
            for _ in range(rng.randrange(0, 3)):
                quote[rng.randrange(len(quote))] = "changed"
            body[10:10] = [w.upper() for w in quote]
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "one  TWO"), (503, "one two three"), (None, items[0][1]), (504, items[1][1]), (504, "other")]

    def sh(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, t in docs:
        for i, u in items:
            a, b = sh(t), sh(u)
            if d is not None and i is not None and b and len(a & b) * 100 >= len(b) * 80:
                want.add((d, i, len(a & b), len(b)))
    D, B = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contained_items(D, B)
    assert {tuple(r[c] for c in ("doc_id", "item_id", "n_shared", "n_item")) for r in got.collect()} == want and want
    left = decontaminate.decontaminated(D, B)
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted((d if d is not None else -1) for d, _ in docs if d not in {w[0] for w in want})
    assert decontaminate.contained_items(D.limit(0), B).count() == 0 and decontaminate.contained_items(D, B.limit(0)).count() == 0
    assert decontaminate.decontaminated(D, B.limit(0)).count() == len(docs)


@pytest.mark.parametrize("bits", [1 << 6, 1 << 26])
def test_containment_with_templates_blocks_and_a_full_filter(spark, monkeypatch, bits):
    """A template in most items, documents that quote many items, blocks of few shingles, and a filter that lets all through."""
    rng = random.Random(3)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "SHINGLES_A_BLOCK", 100)
    monkeypatch.setattr(decontaminate, "TEMPLATE", 8)
    template = "answer the question below in one short sentence"
    items = [(i, f"{template} " + " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 4, 8, 9, 16, 17, 40]))), -i, "x", 0, 1) for i in range(60)]
    items += [(7, "a second text of item seven, of its own words", 0, "y", 0, 1)]
    docs = [(i, " ".join([template, f"d{i}"] + [items[rng.randrange(61)][1] for _ in range(rng.choice([0, 1, 2, 30]))]), i, 1, 2, "z") for i in range(40)]
    docs += [(3, "a second text of item seven, of its own words and more", 1, 1, 1, "z"), docs[5]]

    def sh(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    want = {}
    for d, t, *_ in docs:
        for i, u, *_ in items:
            a, b = sh(t), sh(u)
            if len(a & b) * 100 >= len(b) * 80:
                was = want.get((d, i), (0, 0))
                want[d, i] = (max(was[0], len(a & b)), max(was[1], len(b)))
    D = spark.createDataFrame(docs, "doc_id bigint, text string, h bigint, part int, holds int, items string")
    B = spark.createDataFrame(items, "item_id bigint, text string, doc_id bigint, h string, needed int, row int")
    got = decontaminate.contained_items(D, B).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in got} == want and len(got) == len(want)
    assert decontaminate.contained_items(D, B.limit(0)).dtypes == decontaminate.contained_items(D.limit(0), B).dtypes
    assert {r["doc_id"] for r in decontaminate.decontaminated(D, B).collect()} == {d[0] for d in docs} - {d for d, _ in want}


def test_size_partitions_are_exact_at_powers_of_two(spark):
    sizes = [1, 2, 3, 4, 5, 8, 9, 1024, 1025, (1 << 29), (1 << 29) + 1]
    part = decontaminate._size_partition(F.col("n"))
    rows = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", part.alias("p"), decontaminate._least_held(part, 80).alias("least")).collect()
    assert [r["p"] for r in rows] == [(n - 1).bit_length() for n in sizes]
    assert all(r["least"] * 100 <= max(r["n"] * 80 + 99, 100) for r in rows)  # no document that holds 80 % is too small


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_match_the_plain_patterns(spark):
    rng = random.Random(12)
    parts = ["token", "=", ":", " ", '"', "api_key", "APIKEY", "ſecret", "passwd", "abc", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "\x01", "\x02", "😀", "secret", "x9-_/+", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))), f"s{i % 7}") for i in range(1500)]
    rows += [(5000, None, None), (5001, "", "s"), (None, "token=abcdefgh12", None), (5002, "token=a token: token=12345678", "s"), (5003, "z" * 200_000 + " password=12345678", "s")]
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    texts = {i: (t or "") for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        want = secret_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(s.startswith(f"{k}:") for s in want.split(",")) for k in secrets.KINDS]
    assert secrets.secrets(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_ownership_tells_examples_from_live_secrets(spark):
    live = "Zk39dk2LqW81"
    rows = [(i, "password=example1234 and more", f"owner{i % 5}") for i in range(10)] + [(50, f"password={live}", "me"), (51, f"so I pasted {live} here", "me"), (52, "nothing", "me")]
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert (got[0]["n_example"], got[0]["n_live"]) == (1, 0) and (got[50]["n_example"], got[50]["n_live"]) == (0, 1)
    at = rows[11][1].index(live)
    assert got[51]["spans"] == f"assign:{at}:{at + len(live)}" and got[51]["n_assign"] == 0 and got[52]["spans"] == ""


def test_bare_live_values_are_found_at_sentence_ends_and_behind_keys(spark):
    values = ["Zk39dk2LqW81", "qRtYuIoPlKjH", "abCD12+/efGH=="]
    texts = [f"password={v} here" for v in values]
    bare = [f.format(v) for v in values for f in ("It was {}.", "pw={}", "x=y={}", "Use pw={}. Then", "{}/", "so {} it is")]
    rows = [(i, t, "me") for i, t in enumerate(texts + bare + ["token: wonderful thing", "a wonderful day"])]
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    for i, text, _ in rows[3:-2]:
        v = values[(i - 3) // 6]
        assert got[i] == f"assign:{text.index(v)}:{text.index(v) + len(v)}", text
    assert got[len(rows) - 1] == ""


def test_a_value_in_many_repositories_of_one_owner_is_an_example(spark):
    rows = [(i, f"password=placeholder12 in file {i}", "hot") for i in range(40)] + [(50, "bare placeholder12 here", "hot"), (60, "token=Zk39dk2LqW81", "hot"), (61, "token=Zk39dk2LqW81", "hot")]
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {(got[i]["n_example"], got[i]["n_live"]) for i in range(40)} == {(1, 0)} and got[50]["spans"] == ""
    assert (got[60]["n_example"], got[60]["n_live"]) == (0, 1)


def test_bare_values_spelt_in_letters_and_in_rows_without_an_id(spark):
    rows = [(1, "password=correcthorsebattery here", "me"), (2, "then correcthorsebattery again", "me"), (None, "so correcthorsebattery. And", "me"), (3, "token=Zk39dk2LqW81", "me"), (None, "a Zk39dk2LqW81 b", "me")]
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect())
    assert got == [(0, "assign:2:14"), (0, "assign:3:22"), (1, "assign:0:28"), (2, "assign:5:24"), (3, "assign:0:18")]


def test_a_text_of_many_secrets_takes_little_more_than_linear_time(spark):
    text = " ".join(f"token=Zk39dk2Lq{i:06d} é" for i in range(60_000))
    bare = " ".join(f"w{i}abcdef" for i in range(100_000)) + " Zk39dk2Lq000007"
    began = time.monotonic()
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame([(1, text, "me"), (2, bare, "me")], "doc_id bigint, text string, source string")).collect()}
    assert time.monotonic() - began < 60
    want = secret_spans(text)
    assert got[1]["n_assign"] == 60_000 and got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    at = bare.index("Zk39dk2Lq000007")
    assert got[2]["spans"] == f"assign:{at}:{len(bare)}"


@there
def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut(stage(spark, docs, DATA))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = out
    assert 0 < docs.count() < before
    assert decontaminate.contained_items(docs.select("doc_id", "text"), bench).count() == 0
    assert docs.filter("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0 and docs.filter("copies < 1").count() == 0
    assert sorted(map(repr, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(repr, docs.collect()))


CLASHING = "again number digest h1 h2 size path id own doc first __row __text __more key node comp component kept sig hash dealt copies_ word start more".split()


def clashing_docs(spark):
    """Rows of documents with repeated and null ids, copies, an item and columns of names that the stages use."""
    base = "the tide table of the harbour lists high water for every day of the coming year "
    rows = [(1, base * 3, "a"), (1, base * 3 + "indeed", "a"), (1, "another text that shares no shingle with the rest of them at all", None), (2, base * 3, "b"), (None, base * 3, None), (None, None, None), (3, None, "b"), (4, "", "a")]
    rows += [(10 + i, f"lone{i} words{i} stand{i} here{i} for{i} one{i} document{i} alone{i} mail me{i}@example.org", "ab"[i % 2]) for i in range(12)]
    rows.append((30, "before it what is the name of the ship that the harbour master built in winter after it", "a"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({c: F.lit(f"kept {c}") for c in CLASHING})


def test_pipeline_stages_bear_clashing_columns(spark, tmp_path):
    """Each stage, and all of them one after the other, as of the same rows without the extra columns."""
    spark.createDataFrame([(100, "what is the name of the ship that the harbour master built in winter")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10, 20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = clashing_docs(spark).drop(*CLASHING)
    wide = clashing_docs(spark)
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    chained = wide, plain
    for name, stage in corpus_pipeline.STAGES:
        for w, p in ((wide, plain), chained):
            got, want = stage(spark, w, str(tmp_path)), stage(spark, p, str(tmp_path))
            assert set(CLASHING) <= set(got.columns), name
            alike = "doc_id >= 10" if name == "mixing" else "true"  # which row of a repeated id the mix takes goes by its other columns
            assert sorted(map(repr, got.filter(alike).select(base).collect())) == sorted(map(repr, want.filter(alike).select(base).collect())), name
            assert got.filter(" or ".join(f"`{c}` <> 'kept {c}'" for c in CLASHING)).isEmpty(), name
        chained = cut(got), cut(want)
    left = {r["doc_id"] for r in chained[0].collect()}
    assert {10, 11} <= left and 30 not in left and 2 not in left
