"""Main-text extraction from HTML by a minimum cut.

A page is cut into text blocks in page order. The nodes of its graph are these blocks and the block
elements around them. A linear classifier gives a block a cost of being called content or
boilerplate from its own text alone: length, punctuation, link density, tag. What an element is or is
called (an article, a nav, a class of comments) is evidence about that element only. These costs are
the capacities of the edges to the two terminals. A block is tied to its element and an element to the
one around it, loosely where it begins a region of its own; blocks next to each other and siblings
are tied by edges whose capacity falls with their distance in the tree. The minimum cut, found by
augmenting paths, is the cheapest labelling: a region of good paragraphs outweighs a doubtful name,
and a paragraph does not escape from a footer.

Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import util

#: Elements whose content is never text of the page.
_SILENT = "script|style|noscript|template|textarea|title|iframe|svg|select|canvas|audio|video|button|xmp|noembed|noframes"
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SILENT_TAGS = frozenset(_SILENT.split("|"))
_SILENT_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _SILENT_TAGS}
_STOP = re.compile("[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the key closes when one of the value opens inside it.
_CLOSES = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"}}
_ATTRIBUTE = re.compile(r"""(class|id|role|style|itemprop|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAMES_AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|rail|footer|foot|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|shar\w*|social|comments?|comment\w*|kommentar\w*|comentario\w*|feedback|repl(?:y|ies)|disqus|discussion|related|recommend\w*|widget\w*|pagination|pager|copyright|legal|search|skip|complementary|contentinfo|navigation|dialog|alertdialog|form|tags?|byline-links)(?:$|[\s_-])"
)
_NAMES_HERE = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])")
#: Words that say nothing beside a word that leads away.
_GENERIC = frozenset("box block section list lists links link post posts item items widget wrap wrapper container bar form top bottom area slot inner group row col unit reader readers user users visitor".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_AWAY = frozenset("nav footer aside form menu dialog fieldset head search".split())


@dataclass(frozen=True)
class Weights:
    """Costs of blocks and elements (for content where positive) and the capacities of the ties."""

    bias: float = -1.0
    paragraph: float = 1.0
    heading: float = 0.5
    item: float = -0.5
    length: float = 2.0
    marks: float = 1.5
    links: float = -5.0
    # what an element is or is called
    article: float = 40.0
    named_content: float = 1.0
    doubtful: float = -4.0
    header: float = -12.0
    away: float = -1000.0
    # ties: a block to its element, an element to the one around it, a region to what is around it
    inside: float = 5.0
    around: float = 1000.0
    region: float = 2.0
    next_to: float = 0.8
    sibling: float = 0.4


class _Element:
    """An open element: the block element that it stands in, its place, and what speaks for or
    against it being content."""

    __slots__ = ("tag", "index", "number", "depth", "up", "owner", "inline", "here", "cost", "region", "link")

    def __init__(self, tag: str, index: int, number: int, parent: _Element | None):
        self.tag, self.index, self.number = tag, index, number
        self.here = parent is not None and parent.here  # inside an article or main element
        self.cost, self.region = 0.0, False
        self.link = tag == "a" or parent is not None and parent.link
        if parent is None or tag in _BLOCK:
            self.owner, self.up = self, parent.owner if parent else None  # up: the block around it
            self.depth = self.up.depth + 1 if self.up else 0
            self.inline: dict[str, int] = {}  # open inline elements right inside it
        else:
            self.owner = parent.owner


@dataclass
class Block:
    text: str
    tag: str
    at: _Element
    score: float
    label: bool = field(default=False)


def markup(page: str):
    """(start, end, tag, closing, rest) of each piece of markup in order; comments, declarations
    and elements whose content is never text have an empty tag.

    No part of a page is looked at more often than a fixed number of times, however malformed.
    """
    at, size, plain_until = 0, len(page), 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        m = _TAG.match(page, start + 1)
        if not m and page[start + 1 : start + 2] not in ("!", "?", "/"):
            continue
        end = page.find(">", start + 1)
        if end < 0:
            return
        if m and start >= plain_until:
            # the first > outside of quotes, unless a quote stays open
            k = m.end()
            while stop := _STOP.search(page, k):
                if stop[0] == ">":
                    end = stop.start()
                    break
                close = page.find(stop[0], stop.end())
                if close < 0:
                    plain_until = stop.start()
                    break
                k = close + 1
            else:
                plain_until = size
        at = end + 1
        if not m:
            yield start, at, "", False, ""
            continue
        tag = m[2].lower()
        if not m[1] and tag in _SILENT_TAGS:
            close = _SILENT_END[tag].search(page, at)
            at = close.end() if close else size
            yield start, at, "", False, ""
        else:
            yield start, at, tag, m[1] == "/", page[m.end() : end]


def _leads_away(name: str, value: str, tag: str, inside: bool) -> str:
    """"yes" where an attribute's words mark what isn't main text, "perhaps" where only some of them
    do, else "". Inside an article, paragraphs and headings aren't judged by an id or by some of the
    words, and no other element by some of an id's."""
    line = inside and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6")
    if not _NAMES_AWAY.search(value) or line and name == "id":
        return ""
    words = [w for w in re.split(r"[\s_-]+", value) if w]
    if all(_NAMES_AWAY.search(w) or w in _GENERIC for w in words):
        return "yes"
    if inside:
        return "" if name == "id" or line else "perhaps"
    return "yes"


def blocks_of(page: str, weights: Weights) -> list[Block]:
    """The text blocks of a page in order, each with the classifier's score."""
    out: list[Block] = []
    stack = [_Element("", 0, 0, None)]
    pieces: list[str] = []
    open_blocks: dict[str, int] = {}
    linked, number = 0, 0
    owner = stack[0]  # the innermost block element around the text gathered so far

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                n = len(text)
                score = weights.bias + weights.length * min(n / 120, 1.0) + weights.marks * min(sum(map(text.count, ".,;:!?")) / 4, 1.0)
                score += weights.links * min(linked / n, 1.0)
                if owner.tag in ("p", "pre", "blockquote"):
                    score += weights.paragraph
                elif owner.tag[:1] == "h" and owner.tag[1:].isdigit():
                    score += weights.heading
                elif owner.tag in ("li", "td", "th", "option"):
                    score += weights.item
                out.append(Block(text, owner.tag, owner, score))
            pieces.clear()
        linked = 0

    def text_between(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            raw = page[a:b]
            pieces.append(raw)
            if stack[-1].link:
                linked += len(raw.strip())

    def drop(k: int) -> bool:
        """Close what is open from place ``k`` on; whether a block element was among it."""
        block = False
        while len(stack) > k:
            e = stack.pop()
            if e.owner is e:
                open_blocks[e.tag] -= 1
                block = True
            else:
                e.owner.inline[e.tag] -= 1
        return block

    at = 0
    for start, end, tag, closing, rest in markup(page):
        text_between(at, start)
        at = end
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif closing:
            if tag in _BLOCK:
                flush()
                if open_blocks.get(tag):
                    e = stack[-1].owner
                    while e.tag != tag:
                        e = e.up
                    drop(e.index)
                    owner = stack[-1].owner
            elif stack[-1].owner.inline.get(tag):
                # an inline end tag doesn't close blocks around it
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                drop(k)
        else:
            if tag in _BLOCK:
                flush()
                # inline elements left open don't reach past the block that they stand in
                while tag in _CLOSES.get(stack[-1].owner.tag, ()):
                    drop(stack[-1].owner.index)
            up = stack[-1]
            number += 1
            e = _Element(tag, len(stack), number, up)
            if tag in ("article", "main"):
                e.here, e.region, e.cost = True, True, weights.article
            elif tag in _AWAY:
                e.region, e.cost = True, weights.away
            elif tag == "header" and not up.here:
                e.region, e.cost = True, weights.header
            if rest and not rest.isspace():
                for a in _ATTRIBUTE.finditer(rest):
                    name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    named = name in ("class", "id", "role", "aria-label") and tag not in ("body", "html", "article", "main")
                    leads = _leads_away(name, value, tag, up.here) if named else ""
                    if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value) or leads == "yes":
                        e.region, e.cost = True, weights.away
                    elif leads:
                        e.region, e.cost = True, min(e.cost, weights.doubtful)
                    elif tag in ("article", "main") and name in ("class", "id") and re.search(r"comment|repl(y|ies)|related|teaser|promo", value):
                        e.cost = weights.away
                    elif name in ("class", "id", "role", "itemprop") and e.cost == 0 and _NAMES_HERE.search(value):
                        e.cost = weights.named_content
            if not rest.endswith("/") or tag in _BLOCK or tag == "a":
                stack.append(e)
                if e.owner is e:
                    open_blocks[tag] = open_blocks.get(tag, 0) + 1
                    owner = e
                else:
                    e.owner.inline[tag] = e.owner.inline.get(tag, 0) + 1
    text_between(at, len(page))
    flush()
    return out


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's (content's) side of the minimum cut.

    scores: positive ones are capacities from the source, negative ones to the sink. ties:
    undirected edges (a, b, capacity). Integer capacities, shortest augmenting paths by levels.
    """
    n = len(scores)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, s in enumerate(scores):
        c = round(abs(s) * 1000)
        if c:
            edge(source, k, c, 0) if s > 0 else edge(k, sink, c, 0)
    for a, b, w in ties:
        c = round(w * 1000)
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in heads[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(heads[u]):
                e = heads[u][turn[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]


def tree_distance(a: _Element, b: _Element) -> int:
    """Edges between two block elements, counted up to the first one around both."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def label_blocks(page: str, weights: Weights = Weights()) -> list[Block]:
    """The blocks of a page with their labels (True: content)."""
    found = blocks_of(page, weights)
    scores = [b.score for b in found]
    ties = [(k, k + 1, weights.next_to / (1 + tree_distance(a.at, b.at))) for k, (a, b) in enumerate(zip(found, found[1:], strict=False))]
    last: dict[int, int] = {}
    nodes: dict[int, int] = {}
    for k, b in enumerate(found):
        parent = b.at.up.number if b.at.up else 0
        if (before := last.get(parent)) is not None:
            ties.append((before, k, weights.sibling))
        last[parent] = k
        # the elements around a block, up to one that is in the graph already
        below, tie, e = k, weights.inside, b.at
        while e is not None:
            known = e.number in nodes
            if not known:
                nodes[e.number] = len(scores)
                scores.append(e.cost)
            ties.append((below, nodes[e.number], tie))
            if known:
                break
            below, tie, e = nodes[e.number], weights.region if e.region else weights.around, e.up
    if scores and not (all(s >= 0 for s in scores) or all(s <= 0 for s in scores)):
        sides = minimum_cut(scores, ties)
    else:
        sides = [s > 0 for s in scores]
    for b, side in zip(found, sides, strict=False):
        b.label = side
    return found


def main_text(page: str, weights: Weights = Weights()) -> str:
    """The content blocks of a page, joined by empty lines."""
    return "\n\n".join(b.text for b in label_blocks(page, weights) if b.label)


def extract(pages: DataFrame, weights: Weights = Weights(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text for every row of ``pages``; the text is empty where nothing is content.

    A null or empty page has an empty text. Repeated rows and null ids or urls give a row each, an
    empty table gives none, other columns are not read, and pages of any length are read whole.
    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined in page order by one empty line.
    """
    schema = T.StructType([util.field(pages, id_col), util.field(pages, url_col), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            text = [main_text(h.as_py() or "", weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(text, arrow.field(2).type)], schema=arrow)

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(run, schema)
