"""Main text of web pages by tag-path ratios: paths with much text and punctuation to a node hold the article."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from heapq import heappop, heappush
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import per_batch, shipped

#: Nodes on either side that smoothing looks at, and its standard deviation.
REACH = 2
SIGMA = 1.0
#: Paths below this share of the best fused ratio hold no article of their own.
THRESHOLD = 0.2
#: An ``article`` or ``main`` with less than this share of the largest one's good text is a teaser.
HELD_SHARE = 0.2
#: Good text beside an element joins it from this share of its own on.
JOINED_SHARE = 0.05
#: Text from which a doubtful class word does not count.
PROSE_CHARS = 200

#: Tags that stay inside a block of text. Fixed by the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text below these is no text of the page.
HIDDEN = frozenset("script style template noscript head title textarea select option button svg math canvas object iframe audio video map datalist".split())
#: Their content is characters up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Tags and class words of what surrounds an article.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
BOILERPLATE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promoted promotion
    nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer foot masthead topbar toolbar
    cookie cookies consent gdpr notice notices popup overlay modal alert paywall subscribe subscription newsletter signup login
    comment comments commentlist respond reply replies disqus related recommended recommendations share sharing social
    widget widgets pagination pager skip outbrain taboola""".split()
)
#: Words that also name an article's own sections.
DOUBTFUL_WORDS = frozenset("copyright legal discussion".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
HOLDERS = frozenset("article main".split())
#: What holds short blocks of an article; judged as a whole, not by the length of an item.
CONTAINERS = frozenset("ul ol dl table blockquote figure".split())

#: A start tag of the key ends an open tag of the value, up to the given holder.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
ENDS = {t: ({"p"}, {"button"}) for t in _BLOCKS.split()} | {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SENTENCE_END = re.compile(r"[.!?…。！？]")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


@dataclass
class Page:
    """Elements and blocks of a page. Elements have ascending numbers, each after its parent's; 0 is the root.

    ``path`` numbers the tag names from the root, so that elements of one path
    share it whatever their ids; what is inherited is known when an element
    opens.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    odd: list[bool] = field(default_factory=lambda: [False])
    hidden: list[bool] = field(default_factory=lambda: [False])
    holder: list[int] = field(default_factory=lambda: [-1])
    named: list[int] = field(default_factory=lambda: [0])
    region: list[int] = field(default_factory=lambda: [0])
    node: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def open(self, parent: int, tag: str, attributes: str) -> int:
        """Add an element; its number."""
        named, odd = 0, tag in BOILERPLATE_TAGS or tag == "header" and self.holder[parent] < 0
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                value, name = next((v for v in values if v), ""), name.lower()
                if name in ("class", "id"):
                    if tag not in ("html", "body"):
                        words = {w.lower() for w in _WORD.findall(value)}
                        named = max(named, 2 if words & BOILERPLATE_WORDS else 1 if words & DOUBTFUL_WORDS else 0)
                elif name == "role":
                    odd |= value.lower() in BOILERPLATE_ROLES
                elif name == "style":
                    odd |= _INVISIBLE.search(value) is not None
                elif name == "hidden" or name == "aria-hidden":
                    odd |= name == "hidden" or value.lower() == "true"
        number = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1))
        self.odd.append(odd or self.odd[parent])
        self.hidden.append(tag in HIDDEN or self.hidden[parent])
        self.holder.append(self.holder[parent] if self.holder[parent] >= 0 else number if tag in HOLDERS else -1)
        self.named.append(named)
        self.region.append(number if named else self.region[parent])
        return number

    def summed(self, values: list[int], at: list[int]) -> list[int]:
        """The sum of blocks' values below each element."""
        total = [0] * len(self.parent)
        for n, v in zip(at, values):
            total[n] += v
        for n in range(len(total) - 1, 0, -1):
            total[self.parent[n]] += total[n]
        return total


def read(html: str) -> Page:
    """The page's elements and its blocks of text in order. Open tags are ended as the standard says."""
    page = Page()
    stack: list[int] = [0]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, inside_link = 0, False

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.node.append(stack[-1])
                page.text.append(text)
                page.linked.append(linked)
        linked = 0

    def pop_to(k: int) -> None:
        close_block()
        for n in stack[k:]:
            places[page.tag[n]].pop()
        del stack[k:]

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece and not page.hidden[stack[-1]]:
            parts.append(piece)
            if inside_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                inside_link = False
            elif tag not in INLINE:
                if places.get(tag):
                    pop_to(places[tag][-1])
                elif tag == "p":
                    close_block()
            continue
        if tag in INLINE:
            if tag == "a":
                inside_link = True
            elif tag == "br":
                parts.append(" ")
            continue
        ends, until = ENDS.get(tag, ((), ()))
        if ends:
            floor = max((places[t][-1] for t in until if places.get(t)), default=0)
            first = [p[bisect_right(p, floor)] for t in ends if (p := places.get(t)) and p[-1] > floor]
            if first:
                pop_to(min(first))
        close_block()
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].endswith("/") and tag in HIDDEN:
            continue
        if tag == "body":
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] != "html":
                    places[page.tag[stack[k]]].pop()
                    del stack[k]
            for k, n in enumerate(stack[1:], 1):
                places["html"][k - 1] = k
        places.setdefault(tag, []).append(len(stack))
        stack.append(page.open(stack[-1], tag, m[3]))
    close_block()
    return page


def open_blocks(page: Page) -> list[bool]:
    """Which blocks stand in no boilerplate element.

    An element whose class or id has a boilerplate word is one, unless it wraps
    the article: it holds the page's first ``h1``, prose, and more text than
    all that stands outside such elements; or no prose stands outside them and
    it has over ten times the text that does, the largest of them first. A
    doubtful word counts only where no prose stands.
    """
    own = [not page.odd[n] for n in page.node]
    size = [max(len(t) - k, 0) if o and page.tag[n] not in HEADINGS else 0 for t, k, o, n in zip(page.text, page.linked, own, page.node)]
    prose = [(v >= 80 or v > 0 and page.tag[n] == "p") and _SENTENCE_END.search(t) is not None for v, n, t in zip(size, page.node, page.text)]
    inside, telling = page.summed(size, page.node), page.summed(prose, page.node)
    marked = [n for n in range(1, len(page.parent)) if page.named[n]]
    free = {0} | {n for n in marked if page.named[n] == 1 and telling[n] and inside[n] >= PROSE_CHARS}
    region = {n: [0, 0] for n in [0, *marked]}
    for v, k, n in zip(size, prose, page.node):
        region[page.region[n]][0] += v
        region[page.region[n]][1] += k
    inner: dict[int, list[int]] = {}
    for n in marked:
        inner.setdefault(page.region[page.parent[n]], []).append(n)
    rest = region[0][0]
    title = next((n for n, o in zip(page.node, own) if o and page.tag[n] == "h1"), None)
    while title is not None and title > 0:
        if page.named[title] and telling[title] and inside[title] > rest:
            free.add(title)
        title = page.parent[title]
    shown, told, edge, reached = 0, 0, [], [0]
    while True:
        while reached:
            n = reached.pop()
            shown, told = shown + region[n][0], told + region[n][1]
            for x in inner.get(n, ()):
                if x in free:
                    reached.append(x)
                elif telling[x]:
                    heappush(edge, (-inside[x], x))
        if told or not edge or -edge[0][0] <= 10 * shown:
            break
        reached.append(heappop(edge)[1])
        free.add(reached[-1])
    blocked = {0: False}
    for n in marked:
        blocked[n] = n not in free or blocked[page.region[page.parent[n]]]
    return [o and not blocked[page.region[n]] for o, n in zip(own, page.node)]


def path_ratios(page: Page, own: list[bool]) -> dict[int, float]:
    """The fused ratio of each path.

    A path's ratio is its text, less linked text, to a node, raised by its
    punctuation to a node. Ratios are smoothed over the page's order, then
    fused: each path takes the mean of its nodes' smoothed ratios.
    """
    if not page.node:
        return {}
    path = np.array([page.path[n] for n in page.node])
    text = np.array([max(len(t) - k, 0) if o else 0 for t, k, o in zip(page.text, page.linked, own)], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.text], float)
    known, at = np.unique(path, return_inverse=True)
    nodes = np.bincount(at)
    ratio = np.bincount(at, text) / nodes * (1 + np.bincount(at, marks) / nodes) ** 0.5
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratio[at], REACH, mode="edge"), kernel / kernel.sum(), mode="valid")
    return dict(zip(known.tolist(), np.maximum(np.bincount(at, smooth) / nodes, 0.0).tolist()))


def main_blocks(page: Page) -> list[str]:
    """The blocks that hold the article.

    Paths whose fused ratio reaches a share of the best one's are the
    article's. An ``article`` or ``main`` is one vote among others: such
    elements are the holders if they have most of the text of those paths, the
    larger of them; else the holder is the element with most text of the best
    path, or the ancestor at which other good text joins it. In a holder the
    blocks right below it, headings, those of good paths and the article's
    lists and tables belong, unless a boilerplate element holds them.
    """
    own = open_blocks(page)
    fused = path_ratios(page, own)
    weight: dict[int, int] = {}
    for n, t, o in zip(page.node, page.text, own):
        if o:
            weight[page.path[n]] = weight.get(page.path[n], 0) + len(t)
    if not weight:
        return []
    best = max(sorted(weight), key=lambda p: fused[p] * weight[p] ** 0.5)
    least = THRESHOLD * fused[best]
    good = [len(t) if o and fused[page.path[n]] >= least else 0 for n, t, o in zip(page.node, page.text, own)]
    held: dict[int, int] = {}
    for n, v in zip(page.node, good):
        if page.holder[n] >= 0:
            held[page.holder[n]] = held.get(page.holder[n], 0) + v
    most = max(held.values(), default=0)
    holders = {h for h, v in held.items() if v and v >= HELD_SHARE * most}
    if not holders or 2 * sum(held[h] for h in holders) < sum(good):
        out = [o and page.holder[n] >= 0 for n, o in zip(page.node, own)]
        good = [0 if x else v for v, x in zip(good, out)]
        own = [o and not x for o, x in zip(own, out)]
        holders = {_holder(page, good, best)}
    within = _within(page, holders)
    own = [o and within[n] >= 0 for n, o in zip(page.node, own)]
    kept = [o and (n in holders or page.parent[n] in holders or fused[page.path[n]] >= least or page.tag[n] in HEADINGS) for n, o in zip(page.node, own)]
    return [t for t, k, c in zip(page.text, kept, _contained(page, own, kept, holders)) if k or c]


def _holder(page: Page, good: list[int], best: int) -> int:
    """The parent of most text of the best path, or the ancestor at which other good text joins it."""
    core: dict[int, int] = {}
    for n, v in zip(page.node, good):
        if page.path[n] == best:
            parent = max(page.parent[n], 0)
            core[parent] = core.get(parent, 0) + v
    total = page.summed(good, page.node)
    at = max(sorted(core), key=core.__getitem__) if core else 0
    while at > 0 and total[page.parent[at]] >= total[at] * (1 + JOINED_SHARE):
        at = page.parent[at]
    return at


def _within(page: Page, holders: set[int]) -> list[int]:
    """The holder that each element is in or is, -1 outside."""
    within = [0 if 0 in holders else -1]
    for n in range(1, len(page.parent)):
        within.append(n if n in holders else within[page.parent[n]])
    return within


def _contained(page: Page, own: list[bool], kept: list[bool], holders: set[int]) -> list[bool]:
    """Which blocks stand in a list, table or the like that belongs to the article.

    The outermost one below the holder decides for all its blocks: less than
    half of its text is linked, and it stands in an ``article`` or ``main``,
    between kept blocks or beside one.
    """
    outer = [-1]
    for n in range(1, len(page.parent)):
        outer.append(-1 if n in holders else outer[page.parent[n]] if outer[page.parent[n]] >= 0 else n if page.tag[n] in CONTAINERS else -1)
    totals: dict[int, list[int]] = {}
    for n, t, k, o in zip(page.node, page.text, page.linked, own):
        if o and outer[n] >= 0:
            total = totals.setdefault(outer[n], [0, 0])
            total[0] += len(t)
            total[1] += k
    places = [k for k, x in enumerate(kept) if x]
    beside = {page.parent[n] for n, k in zip(page.node, kept) if k}

    def belongs(k: int, n: int) -> bool:
        c = outer[n]
        if not own[k] or c < 0 or 2 * totals[c][1] >= totals[c][0]:
            return False
        return page.holder[n] >= 0 or bool(places) and places[0] < k < places[-1] or page.parent[c] in beside

    return [belongs(k, n) for k, n in enumerate(page.node)]


def main_text(html: str) -> str:
    return "\n\n".join(main_blocks(read(html)))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row: the main text of the whole page.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by an empty line. Null and empty pages, and pages of
    boilerplate only, have an empty text. Rows are read one by one: repeated
    rows are equal, null ids and urls pass through, an empty table gives no rows.
    """
    shipped(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [main_text(h.as_py() or "") for h in batch.column(2)]
        return {"page_id": batch.column(0).to_pylist(), "url": batch.column(1).to_pylist(), "text": found, "n_chars": [len(t) for t in found]}

    own = pages.select(*[F.col(f"`{c}`") for c in (id_col, url_col, html_col)])
    return own.mapInArrow(per_batch(run, _SCHEMA), "page_id long, url string, text string, n_chars long")
