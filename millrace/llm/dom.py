"""A small document tree of HTML pages, with what a classifier needs to know of each node."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])").split
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag and not shown: scripts and styles with what
#: stands in for scripts, fields of forms, other pages, and formulas once more in another notation.
RAW = frozenset("script style template noscript iframe noembed noframes select textarea annotation annotation-xml".split())
#: Elements of which only some is shown: drawings show their texts, and an xmp is shown as it stands.
PARTLY = frozenset(["svg", "xmp"])
INLINE_RAW = frozenset(["svg", "annotation", "annotation-xml"])
ANY_TAG = re.compile(r"<[^>]*>")
SVG_TEXT = re.compile(r"<text\b[^>]*>(.*?)</text\s*>", re.S | re.I)
#: Tags that no drawing or choice holds: there an element of these that was never closed ends, and its page goes on.
BLOCKS = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td th thead tr ul"
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(BLOCKS.split())})(?=[\s/>])", re.I)
#: Elements that end at such a tag even before an end tag, and those that do if there is none; scripts, styles and fields of text go on to the end.
BROKEN_OUT = frozenset(["svg", "select"])
NEVER_CLOSED = frozenset("svg select template noscript iframe noembed noframes annotation annotation-xml".split())
FOREIGN = re.compile(r"<(?:foreignObject|desc|title)\b", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mspace mtable mtr mtd".split())
#: What an open element of the first kind is closed by.
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th body".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Elements that an open one isn't looked for beyond.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "p": frozenset(["table", "td", "th", "button", "object"])}

#: By a tag: the open elements that it closes, and those that it looks no further than.
CLOSED_BY = {name: [x for x in CLOSES if name in CLOSES[x]] for name in set().union(*CLOSES.values())}
BARRIERS = ("article", "section", "main", "table")
#: End tags of these aren't looked for far beyond a barrier.
LOCAL = frozenset(["p", "li", "div", "span", "td", "tr"])

KINDS = ["html body", "head title", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "aside", "header", "footer", "form fieldset button legend", "table tbody thead tfoot tr", "td th", "blockquote pre figure figcaption", "dialog details summary"]
KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
OTHER = len(KINDS)

#: Tokens of class, id and role by what they tell of a node.
WORDS = [
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs pagination pager toc links skip",
    "header head masthead topbar top footer foot bottom copyright legal colophon contentinfo banner branding logo site",
    "sidebar side aside rail widget widgets related recommended recommendations more trending popular teaser tags archive complementary secondary",
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion promoted dfp doubleclick outbrain taboola",
    "cookie cookies consent gdpr notice alert warning popup modal overlay toast paywall notification disclaimer message banner",
    "form login signin signup subscribe subscription newsletter search searchbox contact register input field",
    "comment comments commentlist respond reply replies discussion disqus reviews feedback thread guestbook reader readers",
    "share sharing social follow facebook twitter byline author meta metadata print toolbar tools buttons",
    "article content main post entry story text body prose page blogpost articlebody storybody maincontent copy",
]
GROUP = {}
for _bit, _words in enumerate(WORDS):
    for _w in _words.split():
        GROUP[_w] = GROUP.get(_w, 0) | 1 << _bit
GROUPS = len(WORDS)


@lru_cache(maxsize=20_000)
def told(attributes: str) -> int:
    """The groups that the tokens of an element's attributes are in, as bits."""
    bits = 0
    for value in NAMED.findall(attributes):
        for token in SPLIT(CAMEL.sub(" ", value.strip("\"'")).lower()):
            bits |= GROUP.get(token, 0)
    return bits


class Open:
    """The open elements, with the places of each name, so that looking for one does not go through all."""

    def __init__(self):
        self.names, self.nodes = ["html"], [0]
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, node: int) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def last(self, name: str) -> int:
        """The place of the last open element of a name, or 0."""
        places = self.at.get(name)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Close all elements from a place on."""
        for name in reversed(self.names[place:]):
            self.at[name].pop()
        del self.names[place:], self.nodes[place:]

    def end(self, name: str) -> None:
        """An end tag: closes the last element of its name, unless that is far beyond a barrier."""
        place = self.last(name)
        if not place:
            return
        if name in LOCAL:
            for barrier in BARRIERS:
                places = self.at.get(barrier, ())
                k = bisect_left(places, len(self.names) - 8)
                if k and places[k - 1] > place:
                    return
        self.cut(place)

    def begin(self, name: str) -> None:
        """A tag: closes the last open element that can't hold it, if no barrier is in between."""
        closes = max((self.last(x) for x in CLOSED_BY.get(name, ())), default=0)
        if closes and closes >= max(max(map(self.last, BARRIERS)), max((self.last(x) for x in SCOPE.get(name, ())), default=0)):
            self.cut(closes)


def raw_end(source: str, name: str, begin: int) -> tuple[int, int]:
    """Where the content of a raw element ends, and where the page goes on.

    A drawing or choice ends at a block's tag if it isn't closed before, other elements if they are never
    closed. What a drawing holds of other pages may have blocks.
    """
    close = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(source, begin)
    if name in BROKEN_OUT or (close is None and name in NEVER_CLOSED):
        block = BLOCK_TAG.search(source, begin, close.start() if close else len(source))
        if block and not FOREIGN.search(source, begin, block.start()):
            return block.start(), block.start()
    return (close.start(), close.end()) if close else (len(source), len(source))


class Page:
    """The elements of a page that aren't inline, in page order, and its runs of text.

    Node 0 stands for the page. A run is text without a block's begin or end in it.
    """

    def __init__(self, source: str):
        self.kind, self.parent, self.told, self.depth = [0], [-1], [0], [0]
        self.tag_count, self.link_chars = [0], [0]
        self.run_node: list[int] = []
        self.run_text: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        open_ = Open()
        nodes = open_.nodes  # the node that each open element belongs to
        links, buffer, pos, size = 0, [], 0, len(source)

        def flush() -> None:
            if buffer:
                text = "".join(buffer)
                buffer.clear()
                if "&" in text:
                    text = html.unescape(text)
                text = " ".join(text.split())
                if text:
                    self.run_node.append(nodes[-1])
                    self.run_text.append(text)

        while pos < size:
            found = TAG.search(source, pos)
            text = source[pos : found.start() if found else size]
            if text:
                buffer.append(text)
                if links:
                    self.link_chars[nodes[-1]] += len(text)
            if found is None:
                break
            pos = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            self.tag_count[nodes[-1]] += 1
            if found[1]:
                if name == "a":
                    links = max(0, links - 1)
                if name in INLINE:
                    continue
                if name == "br":
                    buffer.append(" ")
                    continue
                flush()
                links = 0
                open_.end(name)
                continue
            if name in INLINE:
                if name == "a":
                    links = 1
                continue
            if name == "br":
                buffer.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in RAW or name in PARTLY:
                begin = pos
                if not source[found.start() : pos].endswith("/>"):
                    end, pos = raw_end(source, name, begin)
                    inner = source[begin:end]
                    if name == "svg":
                        buffer += [f" {ANY_TAG.sub(' ', x)} " for x in SVG_TEXT.findall(inner)]
                    elif name == "xmp":
                        buffer.append(html.escape(inner))
                if name not in INLINE_RAW:
                    flush()
                continue
            flush()
            links = 0
            open_.begin(name)
            self.parent.append(nodes[-1])
            self.kind.append(KIND.get(name, OTHER))
            self.depth.append(self.depth[nodes[-1]] + 1)
            self.told.append(told(found[3]) if len(found[3]) > 4 else 0)
            self.tag_count.append(1)
            self.link_chars.append(0)
            open_.push(name, len(self.kind) - 1)
        flush()

    def features(self) -> np.ndarray:
        """A row for each node: its kind, attribute tokens, ancestors, subtree densities, depth and siblings."""
        n = len(self.kind)
        parent, kind = np.array(self.parent), np.array(self.kind)
        own = np.zeros(n)
        marks, upper = np.zeros(n), np.zeros(n)
        for node, text in zip(self.run_node, self.run_text, strict=True):
            own[node] += len(text)
            marks[node] += text.count(".") + text.count(",")
            upper[node] += sum(map(str.isupper, text))
        direct = own.copy()
        link, tags = np.minimum(np.array(self.link_chars, float), own), np.array(self.tag_count, float)
        paragraphs, bodies = (kind == KIND["p"]).astype(float), ((kind == KIND["article"]) | (kind == KIND["main"])).astype(float)
        size, children = np.ones(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (own, marks, upper, link, tags, paragraphs, bodies, size):
                x[p] += x[i]
            children[p] += 1
        above_words, above_kinds = np.zeros(n, np.int64), np.zeros(n, np.int64)
        index, same, before, after, last = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), {}
        count: dict[tuple[int, int], int] = {}
        for i in range(1, n):
            p = parent[i]
            above_words[i] = above_words[p] | self.told[p]
            above_kinds[i] = above_kinds[p] | 1 << int(kind[p])
            if p in last:
                before[i] = own[last[p]]
                after[last[p]] = own[i]
                index[i] = index[last[p]] + 1
            last[p] = i
            count[p, kind[i]] = count.get((p, kind[i]), 0) + 1
        for i in range(1, n):
            same[i] = count[parent[i], kind[i]] / children[parent[i]]
        up = np.maximum(parent, 0)
        out = [
            *(kind == k for k in range(OTHER + 1)),
            *((np.array(self.told) >> b) & 1 for b in range(GROUPS)),
            *((above_words >> b) & 1 for b in range(GROUPS)),
            *((above_kinds >> KIND[k]) & 1 for k in ("nav", "header", "footer", "aside", "form", "article", "main", "li", "head")),
            np.array(self.depth),
            np.log1p(own),
            np.log1p(direct),
            link / np.maximum(own, 1),
            tags / np.maximum(own, 1),
            marks / np.maximum(own, 1),
            upper / np.maximum(own, 1),
            np.log1p(size),
            np.log1p(children),
            np.log1p(paragraphs),
            bodies > 0,
            np.full(n, bodies[0] > 0),
            index / np.maximum(children[up], 1),
            np.log1p(children[up]),
            same,
            np.log1p(before),
            np.log1p(after),
            own / max(1.0, own[0]),
            own / np.maximum(own[up], 1),
            np.log1p(own[up]),
            link[up] / np.maximum(own[up], 1),
            np.log1p(paragraphs[up]),
            kind[up],
        ]
        return np.stack([np.asarray(x, float) for x in out], 1)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Which nodes are kept: the likeliest choice in which nothing is kept inside what is dropped.

        A node that is kept adds its log-odds; one whose parent is dropped cannot be kept. So a node
        is worth the larger of nothing and its own log-odds with what its children are worth.
        """
        n = len(self.kind)
        worth = odds.copy()
        for i in range(n - 1, 0, -1):
            if worth[i] > 0:
                worth[self.parent[i]] += worth[i]
        keep = np.zeros(n, bool)
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and worth[i] > 0
        return keep

    def text(self, keep: np.ndarray) -> str:
        return " ".join(t for node, t in zip(self.run_node, self.run_text, strict=True) if keep[node])
