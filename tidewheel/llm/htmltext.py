"""Main text of web pages by consensus host paths.

Pass one parses each page, scores its containers (text that is neither boilerplate
nor links) and votes for the generalised tag-class paths of its best ones; Spark
sums the votes by host, and on how many pages a path lies beside the best container.  A best container is
widened to the ones around it while they add text, so headings, leads and further
sections stay.  Pass two takes each page's text from the path that won on its host,
or from the page's own best container where that path is missing or holds little.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.session import broadcast_if_small, cut
from tidewheel.llm.textkernel import text_slices

HOSTS_A_BROADCAST = 50_000

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math".split())
SKIPPED = RAW | frozenset("head nav header footer aside form button select option dialog menu canvas audio video".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
BREAKING = BLOCKS | frozenset("head nav header footer aside form dialog menu".split())
CONTAINERS = frozenset("article body div main section td".split())
CLOSES_P = BLOCKS - {"body", "html"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER = re.compile(
    r"(?:^|[\s_-])(ads?|adsbygoogle|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|(?:site|top|main|side|page|sub)?nav|navbar|navigation|menu|breadcrumbs?|(?:site|page|top)?header|masthead|(?:site|page)?footer|sidebar|side|aside|widgets?|notice|cookies?|cookie-?(?:bar|banner|consent)|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|comment-?form|respond|replies|reply|disqus|pagination|pager|toolbar|skip|hidden|alert|disclaimer|copyright)(?=$|[\s_-]|\d)",
    re.I,
)
# Words that also name parts of an article: inside one they have to be a section's whole class.
AMBIGUOUS = frozenset("promo promos promotion promotions banner overlay notice alert modal popup skip hidden related recommended disclaimer copyright side aside".split())
SECTIONS = frozenset("div section ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CAMEL = re.compile(r"([a-z])([A-Z])")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_MEANT = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))


@dataclass(eq=False, slots=True)
class Node:
    """An element; its path is known by a hash of the parent's path and its own step, so depth costs nothing."""

    tag: str
    path: int
    parent: Node | None
    skipped: bool
    at: int = 0  # its place among the nodes
    holder: Node | None = None  # the nearest container around it
    end: int = 0  # the place after its last descendant
    text: int = 0  # characters of its own subtree outside boilerplate
    links: int = 0
    marks: int = 0
    heads: int = 0
    flow: int = 0  # characters that are no links and in no container within it


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    found = {}
    for m in _ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        if name in _MEANT and name not in found:
            found[name] = entities.unescape(m[2] or m[3] or m[4] or "")
    return found


def _named_boiler(tag: str, name: str, inside: bool) -> bool:
    """Whether a class or id says boilerplate; `inside` an article a word of two meanings doesn't, unless it is all that a section is called."""
    for token in CAMEL.sub(r"\1-\2", name).split():
        for m in BOILER.finditer(token):
            if not inside or m[1].lower() not in AMBIGUOUS or (m[0] == token and tag in SECTIONS):
                return True
    return False


def _boiler(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in SKIPPED:
        return True
    if not attrs or tag in ("body", "html", "main", "article"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in HEADINGS:  # a section's heading is text, whatever its class is called
        return False
    return attrs.get("role", "").lower() in ROLES or any(_named_boiler(tag, attrs[a], inside) for a in ("class", "id") if a in attrs)


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A path step: the tag with its classes, digits generalised."""
    names = sorted(set(re.sub(r"\d+", "#", attrs.get("class", "")).split()))
    return ".".join([tag, *names])


def _holds(node: Node) -> bool:
    return node.tag in CONTAINERS or node.parent is None


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The container nodes in page order, and each block's (innermost node, text) outside boilerplate."""
    root = Node("", 0, None, False)
    stack, nodes = [root], [root]
    opened: Counter[str] = Counter()
    blocks: list[tuple[Node, str]] = []
    buffer: list[str] = []
    linked = 0
    in_link = 0
    at = 0
    lower = None

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = stack[-1]
                blocks.append((node, text))
                (node if _holds(node) else node.holder).flow += len(text) - min(linked, len(text))
                node.text += len(text)
                node.links += min(linked, len(text))
                node.marks += sum(text.count(c) for c in ".,;:!?")
                node.heads += node.tag in HEADINGS
        linked = 0

    def leave() -> Node:
        node = stack.pop()
        opened[node.tag] -= 1
        node.end = len(nodes)
        return node

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].skipped:
            text = entities.unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                linked += len(text.strip())

    for m in iter(lambda: _TOKEN.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not stack[-1].skipped:
                buffer.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if opened[tag] > 0:
                if tag in BREAKING or stack[-1].tag != tag:
                    flush()
                while leave().tag != tag:
                    pass
            elif tag == "p":
                flush()
            continue
        attrs = _attributes(m[3])
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link += 1
        if tag in BREAKING:
            flush()
        elif not _boiler(tag, attrs, opened["article"] > 0):
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        leave()
                    break
                if stack[i].tag in CONTAINERS or stack[i].tag in SKIPPED:
                    break
        if tag in CLOSED_BY_SAME and stack[-1].tag in CLOSED_BY_SAME[tag]:
            leave()
        up = stack[-1]
        path = xxhash.xxh64_intdigest(_step(tag, attrs).encode("utf-8", "replace"), up.path)
        node = Node(tag, path, up, up.skipped or _boiler(tag, attrs, opened["article"] > 0), len(nodes), up if _holds(up) else up.holder, len(nodes) + 1)
        nodes.append(node)
        if m[0].endswith("/>") and tag in ("svg", "math"):
            continue
        stack.append(node)
        opened[tag] += 1
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = (lower if len(lower) == len(page) else page).find(f"</{tag}", at)
            at = len(page) if end < 0 else end
    say(page[at:])
    flush()
    while stack:
        leave()
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            for sum_ in ("text", "links", "marks", "heads"):
                setattr(node.parent, sum_, getattr(node.parent, sum_) + getattr(node, sum_))
    return nodes, blocks


def _score(node: Node) -> float:
    plain = node.text - node.links
    bonus = {"article": 2.0, "main": 1.5, "body": 0.5}.get(node.tag, 1.0)
    return plain * bonus * (1 - node.links / max(1, node.text)) + 5 * node.marks


def best_container(nodes: list[Node]) -> Node:
    """The highest score, a smaller container before one that holds it unless that adds much; then widened to what adds text to it."""
    top, most = nodes[0], -1.0
    for node in nodes:
        if _holds(node) and not node.skipped and node.text:
            score = _score(node)
            if score > most or (score >= 0.9 * most and top.at <= node.at < top.end):
                top, most = node, score
    return widened(nodes, [top])[0]


def _same_level(nodes: list[Node]) -> dict[int, tuple[Counter, int]]:
    """For each container the containers directly in it that are not mostly links: how many of each path, and how many with a heading or a mark."""
    found: dict[int, tuple[Counter, list[int]]] = {}
    for node in nodes:
        if node.holder is not None and _solid(node):
            paths, signed = found.setdefault(node.holder.at, (Counter(), [0]))
            paths[node.path] += 1
            signed[0] += _signed(node)
    return {at: (paths, signed[0]) for at, (paths, signed) in found.items()}


def _solid(node: Node) -> bool:
    return _holds(node) and not node.skipped and 0 < node.text >= 2 * node.links


def _signed(node: Node) -> bool:
    return bool(node.marks or node.heads)


def widened(nodes: list[Node], chosen: list[Node], strangers: bool = True) -> list[Node]:
    """For each of `chosen` the widest container around it that adds text, up to one that adds mostly links.

    Text is what stands in that container itself (a heading, a lead), in a container
    of the same tag and classes as the one within, or, with `strangers`, in any
    other with a heading or a punctuation mark.  Around an article or main only
    another one of the same tag and classes counts.  What lies above a container is
    worked out once, so many chosen ones in deep pages cost no more than the page.
    """
    beside = _same_level(nodes)
    declared: dict[int, Node | None] = {}  # the outermost article or main around a container, itself included
    wide: dict[tuple[int, bool], Node | None] = {}

    def step(node: Node, past: bool) -> tuple[Node, bool, bool] | None:
        """The container around `node` with whether it adds text and whether the way on is past the declared one; None where the way ends."""
        up = node.holder
        if up is None or 2 * (up.links - node.links) > up.text - node.text:
            return None
        paths, signed = beside.get(up.at, (Counter(), 0))
        own = _solid(node)
        same = paths[node.path] - own > 0
        if past:
            adds = same and node.tag in ("article", "main")
        else:
            adds = same or up.flow > 0 or (strangers and signed - (own and _signed(node)) > 0)
        return up, adds, past or declared[up.at] is up

    for node in nodes:  # holders come before what they hold
        if _holds(node):
            around = declared[node.holder.at] if node.holder is not None else None
            declared[node.at] = around or (node if node.tag in ("article", "main") else None)
            for past in (False, True):
                taken = step(node, past)
                wide[node.at, past] = None
                if taken is not None:
                    up, adds, beyond = taken
                    wide[node.at, past] = wide[up.at, beyond] or (up if adds else None)
    out = []
    for node in chosen:
        if _holds(node):
            out.append(wide[node.at, declared[node.at] is node] or node)
        else:
            out.append(node)
    return out


def _inside(nodes: list[Node], chosen: list[Node]) -> np.ndarray:
    edges = np.zeros(len(nodes) + 1, dtype=np.int64)
    for node in chosen:
        edges[node.at] += 1
        edges[node.end] -= 1
    return np.cumsum(edges) > 0


def text_at(nodes: list[Node], blocks: list[tuple[Node, str]], path: int | None, passed_over: Collection[int] = ()) -> str:
    """Joined blocks under the nodes of `path`, or under the page's own best container.

    Where the path's nodes are in no article or main, the page may be laid out unlike
    its host: if most of its own best container lies elsewhere, that is joined to
    them, but for containers that the host's pages have and pass over.
    """
    chosen = [n for n in nodes if path and n.path == path and not n.skipped and n.text]
    if not chosen:
        inside = _inside(nodes, [best_container(nodes)])
    else:
        inside = _inside(nodes, widened(nodes, chosen, strangers=False))
        if not any(_declared(n) for n in chosen):
            own = _inside(nodes, [best_container(nodes)]) & ~_inside(nodes, [n for n in nodes if n.path in passed_over])
            if sum(len(text) for node, text in blocks if own[node.at] and not inside[node.at]) > sum(len(text) for node, text in blocks if inside[node.at]):
                inside |= own
    return "\n".join(text for node, text in blocks if inside[node.at])


def _declared(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.holder
    return node is not None


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]+)"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of host and path, summed over a batch: score as a page's best container, and on how many pages it lies within and beside the best one."""
    for batch in batches:
        for part in text_slices(batch, "html"):
            sums: dict[tuple[str, int], list] = {}
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                if page:
                    nodes = parse(page)[0]
                    best = best_container(nodes)
                    if best.text:
                        sums.setdefault((host, best.path), [0.0, 0, 0])[0] += float(best.text) ** 0.5
                    within, beside = set(), set()
                    for n in nodes:
                        if _holds(n) and n.text and not n.skipped and not n.at <= best.at < n.end:
                            (within if best.at <= n.at < best.end else beside).add(n.path)
                    for path in within:
                        sums.setdefault((host, path), [0.0, 0, 0])[1] += 1
                    for path in beside - within:
                        sums.setdefault((host, path), [0.0, 0, 0])[2] += 1
            hosts, paths = zip(*sums, strict=True) if sums else ((), ())
            scores, withins, besides = zip(*sums.values(), strict=True) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.asarray(paths, np.uint64).view(np.int64)), pa.array(scores, pa.float64()), pa.array(withins, pa.int64()), pa.array(besides, pa.int64())], names=["host", "path", "score", "within", "beside"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "html"):
            texts = []
            for page, path, passed in zip(*(part.column(c).to_pylist() for c in ("html", "path", "passed")), strict=True):
                texts.append(text_at(*parse(page), None if path is None else path % (1 << 64), {p % (1 << 64) for p in passed or ()}) if page else "")
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of `pages` (page_id, url, html; others are not read).

    A null or empty html, and one without text outside boilerplate, gives an empty
    text.  Pages whose url names no host vote together as one host.  Votes are
    summed per task before they are dealt out, so a host of any size is one row for
    each path and task; what goes back to its pages is the winner and the paths that
    are beside the best container more than twice as often as within it.  A path is
    known by a 64-bit hash of its steps, and ties go to the least.  Repeated rows are extracted each, no rows give no rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), _HOST, 1)), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path bigint, score double, within bigint, beside bigint")
    tally = votes.groupBy("host", "path").agg(F.sum(F.round("score", 3).cast("decimal(20,3)")).alias("votes"), F.sum("within").alias("within"), F.sum("beside").alias("beside"))
    tally = tally.filter("votes > 0 or within > 0 and beside > 2 * within")
    passed = F.collect_list(F.when(F.expr("within > 0 and beside > 2 * within"), F.col("path")))
    first = tally.groupBy("host").agg(F.max_by("path", F.struct("votes", F.bitwise_not("path"))).alias("path"), passed.alias("passed"))
    winners = broadcast_if_small(cut(first), HOSTS_A_BROADCAST)
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path", "passed").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
