"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks, cut at block-level tags. A linear classifier over structure, link density, length and
punctuation gives each block a cost for either label; the costs are the capacities from the source (content) and to the sink
(boilerplate). Neighbouring blocks, and blocks of one parent, are tied by edges that are stronger the nearer the blocks are in
the DOM. A maximum flow separates them: blocks that the source still reaches are the main text.
The flow is Dinic's with explicit stacks, linear in memory and, on such nearly linear graphs, in time.

The classifier's weights are fixed parameters (`Weights`), not trained: the corpus has no labelled pages. Evidence and edges are on
one scale: what names a part of a page (nav, footer, class=sidebar) outweighs any neighbourhood, also for a long sentence inside an
article, while words, punctuation and links are weak enough for the neighbours to overrule: a short line between paragraphs stays with
them, a long advert without a telling name goes with the lists of links around it. If the cut leaves nothing of a page, the blocks
that the classifier alone takes for content are its text (a lone paragraph between menus).

Defined results: null or blank html gives an empty text; markup that never closes is closed at its parent's end; references
without a semicolon are decoded as browsers do; br is white space inside a block; ids and urls may be null or repeat, each row is
worked on by itself; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Names of HTML elements, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe head title textarea".split())
#: Their text isn't shown as text of the page; they end with their parent.
HELD = frozenset("template object svg canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
BAD_TAGS = frozenset("nav footer aside form menu dialog button select label fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus dropdown footer footnav gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination paywall popup privacy promo promoted promotion recommended replies reply respond share "
    "sharing sidebar signup skip sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that name parts beside an article, but also what an article is about or who wrote it.
WEAK_WORDS = frozenset("byline copyright disclaimer legal related social tags".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Weights:
    """Log-odds of content. Positive speaks for content."""

    prior: float = -1.0
    bad_part: float = -7.5
    good_part: float = 3.0
    good_name: float = 1.5
    weak_name: float = -1.0
    links: float = -5.0
    per_word: float = 0.1
    most_words: float = 2.0
    short: float = -1.0
    sentence: float = 0.5
    heading: float = 1.5
    rights: float = -1.5
    near: float = 3.5
    siblings: float = 0.5
    scale: int = 1000


def named(tag: str, attributes: str, weights: Weights) -> tuple[float, bool]:
    """Evidence from an element's attributes, and whether it is hidden. What an article, a main part or the whole page is called doesn't speak against it."""
    evidence, hidden = 0.0, bool(re.search(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*[\"']?until)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))
    for name, a, b, c in ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "role":
            evidence += weights.bad_part if value.lower() in BAD_ROLES else weights.good_part if value.lower() in ("main", "article") else 0
        else:
            words = {w.lower() for w in WORDS.findall(value)}
            whole = tag in GOOD_TAGS or tag in ("html", "body")
            if words & BAD_WORDS and not whole:
                evidence += weights.bad_part
            else:
                evidence += weights.good_name * bool(words & GOOD_WORDS) + weights.weak_name * (bool(words & WEAK_WORDS) and not whole)
    return evidence, hidden


def blocks(page: str, weights: Weights) -> list[tuple[str, float, int, int]]:
    """(text, evidence, parent's number, steps through the DOM from the block before) of each block that has text."""
    out: list[tuple[str, float, int, int]] = []
    stack: list[tuple[str, float, int, int]] = [("", 0.0, 0, 0)]  # element, evidence of it and what is around it, number, place of the nearest block
    open_tags: dict[str, list[int]] = {}  # places in the stack
    bodyless = False  # no body and no end of a head follow
    count, links, held, pieces, linked, low, at = 0, 0, 0, [], 0, 0, 1
    heading = False

    def flush() -> None:
        nonlocal pieces, linked, low, at
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        pieces = []
        if text:
            k = stack[-1][3]
            n, words = len(text), text.count(" ") + 1
            score = weights.prior + stack[-1][1] + weights.links * min(1.0, linked / n) + min(weights.most_words, weights.per_word * words)
            score += (weights.short if words < 4 else 0) + (weights.sentence if text[-1] in ".!?…:;\"»”" else 0) + (weights.heading if heading else 0)
            if "©" in text or "all rights reserved" in text.lower():
                score += weights.rights
            low = min(low, k + 1)
            out.append((text, score, stack[k][2], max(0, at - low) + max(0, k + 1 - low)))
            at = low = k + 1
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, held, low, heading
        for tag, *_ in stack[to:]:
            open_tags[tag].pop()
            links -= tag == "a"
            held -= tag in HELD
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False
        del stack[to:]
        low = min(low, len(stack))

    def find(tags: tuple[str, ...], stop: tuple[str, ...]) -> int:
        """The place of the innermost of these elements, unless one of `stop` stands inside it."""
        last = lambda names: max((places[-1] for t in names if (places := open_tags.get(t))), default=0)
        k = last(tags)
        return k if k > last(stop) else 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not held:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if links:
                linked += len(raw.strip())

    place = 0
    for found in TAG.finditer(page, 0, page.rfind(">") + 1):  # no tag ends behind the last >, and comments are closed there
        start, end = found.span()
        if start < place:
            continue
        tag = (found[2] or found[5] or "").lower()
        text(page[place:start])
        place = end
        if not tag:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in BLOCK:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            if open_tags.get(tag):
                # An end tag of an inline element doesn't reach through the block that it stands in.
                k = open_tags[tag][-1]
                if tag in BLOCK or tag in HELD or k > stack[-1][3]:
                    pop(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                if tag == "head":  # often left open: ends where the body begins
                    body = None if bodyless else re.compile(r"<body\b|</head\b[^>]*>", re.I).search(page, end)
                    bodyless = body is None
                    place = (body.start() if body[0].lower().startswith("<body") else body.end()) if body else end
                else:
                    skip = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, end)
                    place = skip.end() if skip else len(page)
            continue
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK):
            continue
        if tag in BLOCK and open_tags.get("svg") and (k := find(("svg",), ())):  # drawings hold no blocks
            pop(k)
        if tag in BLOCK and open_tags.get("p") and (k := find(("p",), ("button", "td", "th", "caption", "object"))):
            pop(k)
        if tag in CLOSES and (k := find(CLOSES[tag], ("ul", "ol", "dl", "table", "select"))):
            pop(k)
        evidence, hidden = named(tag, attributes, weights) if attributes.strip() else (0.0, False)
        evidence += weights.bad_part * (hidden or tag in BAD_TAGS) + weights.good_part * (tag in GOOD_TAGS and not open_tags.get(tag))
        if tag == "header" and not (open_tags.get("article") or open_tags.get("main")):
            evidence += weights.bad_part
        count += 1
        open_tags.setdefault(tag, []).append(len(stack))
        stack.append((tag, stack[-1][1] + evidence, count, len(stack) if tag in BLOCK else stack[-1][3]))
        links += tag == "a"
        held += tag in HELD
        heading |= tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    rest = page[place:]
    text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def source_side(capacity: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut: capacity > 0 ties a node to the source, < 0 to the sink."""
    n = len(capacity)
    heads: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, c in edges:  # an edge without direction is its own reverse
        heads[a].append(len(to))
        to.append(b)
        room.append(c)
        heads[b].append(len(to))
        to.append(a)
        room.append(c)
    give, take = [max(0, c) for c in capacity], [max(0, -c) for c in capacity]
    while True:
        level, queue = [-1] * n, [v for v in range(n) if give[v]]
        for v in queue:
            level[v] = 0
        reached = False
        for v in queue:
            reached |= take[v] > 0
            for e in heads[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in range(n):
            while give[s]:
                path, v = [], s
                while True:
                    if take[v]:
                        push = min([give[s], take[v], *(room[e] for e in path)])
                        give[s] -= push
                        take[v] -= push
                        for e in path:
                            room[e] -= push
                            room[e ^ 1] += push
                        break
                    while arc[v] < len(heads[v]):
                        e = heads[v][arc[v]]
                        if room[e] and level[to[e]] == level[v] + 1:
                            break
                        arc[v] += 1
                    else:
                        if not path:
                            v = -1
                            break
                        v = to[path.pop() ^ 1]
                        arc[v] += 1
                        continue
                    path.append(e)
                    v = to[e]
                if v < 0:
                    break


def labels(found: list[tuple[str, float, int, int]], weights: Weights = Weights()) -> list[bool]:
    """Which blocks are content: the minimum cut between the classifier's costs and the ties of neighbours."""
    edges, last = [], {}
    for k, (_, _, parent, steps) in enumerate(found):
        if k:
            edges.append((k - 1, k, int(weights.scale * weights.near / (1 + steps))))
        before = last.get(parent)
        if before is not None and before < k - 1:
            edges.append((before, k, int(weights.scale * weights.siblings)))
        last[parent] = k
    keep = source_side([int(weights.scale * score) for _, score, _, _ in found], edges)
    return keep if any(keep) else [score > 0 for _, score, _, _ in found]


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    """The main text of one page."""
    found = blocks(page or "", weights)
    return "\n".join(text for (text, _, _, _), k in zip(found, labels(found, weights)) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights = Weights()) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
