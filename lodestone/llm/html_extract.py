"""Main text of web pages, with wrappers inferred per host.

A page is a stream of tokens: begins and ends of block elements, and texts.  The
streams of a host are aligned one after the other into a wrapper, a regular
expression without unions, level by level, for begins and ends nest: where the
tokens of two streams differ, those that one side lacks become optional,
neighbours of one kind become a repeated group, and text that differs becomes a
slot.  Wrappers of parts of a host merge the same way, so each task makes its
own and those are folded in two steps, by tasks that hold two wrappers of
bounded size at a time; a host with a third of all pages is no single task's.  A
wrapper says which text of a host's pages is fixed and where the slot with most
text is.

A page's text is that of the region which the host's wrapper names, without the
wrapper's fixed texts.  ``article`` and ``main`` elements are evidence when the
wrapper is weighed: their slots count ``SEMANTIC`` times.  Where a page lacks the
region, its text is that of its own such elements, or else of the body.  Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by element and role wherever they stand, and by class or
id if all its words name such a thing or a part of a page, or its first or last
word can hardly mean anything else: ``share-buttons`` goes, ``share-price`` stays.

Defined results: null or empty html has an empty text; pages without a host
share one wrapper; repeated rows stay; unclosed and stray tags are allowed;
white space is Unicode's; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved
from .url_filter import split_url

# Kinds of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# What is never main text, by element, role, and word of a class or id.
BOILER_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input menu dialog canvas object".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words that name such a thing even beside unknown ones, and words for parts of a page.
STRONG_WORDS = frozenset("advert adverts advertisement breadcrumb breadcrumbs comments cookie cookies disqus footer masthead navbar navigation newsletter sidebar".split())
LAYOUT_WORDS = frozenset(
    "area articles bar block body bottom box button buttons container content div group icons inner item items left link links list lists main middle module outer page panel post posts primary right row secondary section site slot text title top unit wrap wrapper".split()
)
HEADER_WORDS, CONTENT_WORDS = frozenset(["header", "topbar"]), frozenset("article content entry post story".split())

MAX_NODES = 2_000  # of a wrapper; beyond it, the items of fewest pages become text slots of what holds them
MAX_DEPTH = 100  # of a page's tree; deeper elements count as text of their ancestor
HELD_TREES = 2_000  # distinct trees that a task holds before it hands them on
FIXED_PAGES = 5  # pages of different content that must agree on a text for it to be the wrapper's own
MAIN_SHARE = 0.6
SEMANTIC = 10  # weight of text in article and main elements

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element of a page, or an item of a wrapper."""

    __slots__ = ("sig", "kids", "pages", "chars", "text", "optional", "many", "keys", "into")

    def __init__(self, sig: str, pages: int = 1):
        self.sig, self.kids, self.pages = sig, [], pages
        self.chars, self.text, self.optional, self.many = 0, "", False, False
        self.keys: list[str] = []  # contents of the pages that agree on the text, FIXED_PAGES at most
        self.into: Node | None = None  # what this node was merged into

    def shape(self) -> str:
        return f"{self.sig}{'+' * self.many}{'?' * self.optional}({','.join(k.shape() for k in self.kids)})"

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def pack(self) -> list:
        return [self.sig, self.pages, self.chars, self.text, self.optional, self.many, [k.pack() for k in self.kids], self.keys]

    @staticmethod
    def unpack(x: list) -> Node:
        node = Node(x[0], x[1])
        node.chars, node.text, node.optional, node.many = x[2:6]
        node.kids, node.keys = [Node.unpack(k) for k in x[6]], x[7]
        return node


def _attrs(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(text)} if "=" in text else {}


def _boiler_name(name: str) -> bool:
    """Whether a class or id names what is never main text."""
    words = _WORD.findall(name)
    if not words:
        return False
    if words[0] in STRONG_WORDS or words[-1] in STRONG_WORDS:
        return True
    some, known = {w for w in words if w in BOILER_WORDS}, all(len(w) < 3 or w in BOILER_WORDS or w in LAYOUT_WORDS or w in HEADER_WORDS for w in words)
    return known and bool(some or HEADER_WORDS.intersection(words) and not CONTENT_WORDS.intersection(words))


def _is_boiler(tag: str, names: list[str], role: str | None, in_main: bool) -> bool:
    if tag in BOILER_TAGS or tag == "header" and not in_main or role in BOILER_ROLES:
        return True
    if tag in ("body", "html", "article", "main"):
        return any({"comment", "comments"}.intersection(_WORD.findall(n)) for n in names)
    return any(map(_boiler_name, names))


def _names(attrs: dict[str, str]) -> list[str]:
    return [attrs[k] for k in ("class", "id") if attrs.get(k)]


def _named_boiler(sig: str, in_main: bool = False) -> bool:
    tag, *names = sig.split(".")
    return _is_boiler(tag, [n for n in names if not n.startswith("role-")], next((n[5:] for n in names if n.startswith("role-")), None), in_main)


def _kind(sig: str) -> str:
    """What a region's path names: elements that are main text by tag or role are one kind whatever their class."""
    tag, *names = sig.split(".")
    if tag in ("article", "main"):
        return tag
    return next((n for n in names if n in ("role-main", "role-article")), sig)


def _semantic(kind: str) -> bool:
    return kind in ("article", "main", "role-main", "role-article")


def _signature(tag: str, attrs: dict[str, str]) -> str:
    named = [("role-" if k == "role" else "") + re.sub(r"[^a-z]+", "-", attrs[k]) for k in ("class", "id", "role") if attrs.get(k)]
    return ".".join([tag, *named])


class Page:
    """What one pass over a page's html gives: its block tree and its texts with their place in it."""

    def __init__(self, source: str | None):
        self.root = Node("#page")
        self.texts: list[tuple[str, bool, bool, tuple[str, ...], bool, Node]] = []  # text, dropped, in main, path, starts a block, node
        self.fresh = True
        self._read(source or "")

    def _read(self, source: str) -> None:
        # open elements: tag, whether inline, dropped, in main, tree node, path
        stack: list[tuple[str, bool, bool, bool, Node, tuple[str, ...]]] = [("", False, False, False, self.root, ())]
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            start = m.start() if m else end
            if start > at:
                self._text(source[at:start], stack[-1])
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag, stack)
                continue
            inline = tag in INLINE
            if not inline:
                self.fresh = True
                self._imply(tag, stack)
            _, _, dropped, main, node, path = stack[-1]
            attrs = _attrs(m[3])
            dropped = dropped or _is_boiler(tag, _names(attrs), attrs.get("role"), main)
            main = main or tag in ("article", "main") or attrs.get("role") in ("main", "article")
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
                continue
            if not inline and len(path) < MAX_DEPTH:
                child = Node(_signature(tag, attrs))
                node.kids.append(child)
                node, path = child, (*path, child.sig)
            stack.append((tag, inline, dropped, main, node, path))

    def _text(self, raw: str, top: tuple) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        if not text.isspace():
            top[4].chars += len(text)
            top[4].text += text
        self.texts.append((text, top[2], top[3], top[5], self.fresh, top[4]))
        self.fresh = False

    def _close(self, tag: str, stack: list) -> None:
        inline = tag in INLINE
        if not inline:
            self.fresh = True
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if inline and not stack[i][1]:
                return

    @staticmethod
    def _imply(tag: str, stack: list) -> None:
        """End what a new block element ends: an open paragraph, or an item of its own kind."""
        i = len(stack) - 1
        while i > 0 and stack[i][1]:
            i -= 1
        if i > 0 and (opened := stack[i][0]) in CLOSED_BY and (CLOSED_BY[opened] is None or tag in CLOSED_BY[opened]):
            del stack[i:]
            if opened == "p":
                Page._imply(tag, stack)

    def main_text(self, rule: dict | None) -> str:
        own = [t for t in self.texts if not t[1]]
        semantic = [t for t in own if t[2]]
        if not rule:
            own = semantic or own
        else:
            region = tuple(rule["main"])
            inside = [t for t in own if tuple(map(_kind, t[3][: len(region)])) == region]
            if not any(t[0].strip() for t in inside):
                inside = semantic or own
            elif rule["semantic"]:
                inside = [t for t in inside if t[2]] or inside
            own = inside
            fixed = self._fixed(rule["fixed"])
            left = [t for t in own if id(t[5]) not in fixed]
            own = left if any(t[0].strip() for t in left) else own  # a page of nothing else has these texts as its own
        return " ".join("".join(" " + t[0] if t[4] else t[0] for t in own).split())


    def _fixed(self, wrapper: list) -> set[int]:
        """The nodes that stand where the wrapper has a fixed text, and hold that text."""
        if not wrapper[2]:
            return set()
        found: set[int] = set()

        def place(node: Node, item: list) -> None:
            if item[1] and node.text == item[1]:
                found.add(id(node))
            at = 0
            for k in node.kids:
                to = next((i for i in range(at, len(item[2])) if item[2][i][0] == k.sig), None)
                if to is not None:
                    place(k, item[2][to])
                    at = to + 1

        place(tidy(self.root), wrapper)
        out = set()
        for t in self.texts:
            node = t[5]
            while node.into is not None:
                node = node.into
            if id(node) in found:
                out.add(id(t[5]))
        return out


def _collapse(kids: list[Node]) -> list[Node]:
    """Neighbours of one kind become one repeated item."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].sig == k.sig:
            _merge(out[-1], k, same_page=True)
            out[-1].many = True
        else:
            out.append(k)
    return out


def _content(node: Node) -> str:
    """The longest text of a page outside its boilerplate: copies and near copies have the same."""
    if _named_boiler(node.sig):
        return ""
    return max([" ".join(node.text.split()), *map(_content, node.kids)], key=lambda t: (len(t), t))


def tidy(node: Node, key: str | None = None) -> Node:
    """A page's tree as a wrapper of its own."""
    key = key or xxhash.xxh64_hexdigest(_content(node))
    for k in node.kids:
        tidy(k, key)
    if node.chars:
        node.text, node.keys = xxhash.xxh64_hexdigest(" ".join(node.text.split())), [key]
    node.kids = _collapse(node.kids)
    if node.sig == "#page":
        node.keys = [key]
        return bounded(node)
    return node


def _align(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of items, by kind."""
    same = 0
    while same < min(len(a), len(b)) and a[same].sig == b[same].sig:
        same += 1
    if same:  # what both begin with is in a longest one
        return [(k, k) for k in range(same)] + [(i + same, j + same) for i, j in _align(a[same:], b[same:])]
    if not a or not b:
        return []
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].sig == b[j].sig else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i].sig == b[j].sig:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """``a`` aligned with ``b``: what either lacks is optional, texts that differ become a slot."""
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.chars += b.chars
    a.text = a.text if a.text == b.text else "*"
    a.keys = sorted({*a.keys, *b.keys})[:FIXED_PAGES] if a.text != "*" or a.sig == "#page" else []
    b.into = a
    a.optional, a.many = a.optional or b.optional, a.many or b.many
    if a.kids or b.kids:
        kids, i, j = [], 0, 0
        for x, y in [*_align(a.kids, b.kids), (len(a.kids), len(b.kids))]:
            for k in [*a.kids[i:x], *b.kids[j:y]]:
                k.optional = True
                kids.append(k)
            if x < len(a.kids):
                kids.append(_merge(a.kids[x], b.kids[y], same_page))
            i, j = x + 1, y + 1
        a.kids = _collapse(kids)
    return a


def bounded(wrapper: Node) -> Node:
    """``wrapper`` with MAX_NODES at most: leaves of fewest pages, optional ones first, become text slots of their parents."""
    beyond = wrapper.size() - MAX_NODES
    if beyond <= 0:
        return wrapper
    leaves: list[tuple[bool, int, int, int, Node, Node]] = []
    held: dict[int, tuple[Node, int, int]] = {}  # a node's parent, depth and place in the order of the page

    def visit(node: Node, depth: int) -> None:
        for k in node.kids:
            held[id(k)] = (node, depth, len(held))
            visit(k, depth + 1)
            if not k.kids:
                leaves.append((not k.optional, k.pages, -depth, -held[id(k)][2], k, node))

    visit(wrapper, 1)
    left = {id(n): len(n.kids) for n in [wrapper, *(p for p, _, _ in held.values())]}
    heapq.heapify(leaves)
    gone: set[int] = set()
    while beyond > 0 and leaves:
        *_, leaf, parent = heapq.heappop(leaves)
        gone.add(id(leaf))
        beyond -= 1
        parent.chars += leaf.chars
        if leaf.chars:
            parent.text = "*"
            parent.keys = parent.keys if parent is wrapper else []
        left[id(parent)] -= 1
        if not left[id(parent)] and parent is not wrapper:
            above, depth, place = held[id(parent)]
            heapq.heappush(leaves, (not parent.optional, parent.pages, -depth, -place, parent, above))

    def prune(node: Node) -> None:
        n = len(node.kids)
        node.kids = [k for k in node.kids if id(k) not in gone]
        for k in node.kids:
            prune(k)
        if len(node.kids) < n:
            node.kids = _collapse(node.kids)

    prune(wrapper)
    return wrapper


class Fold:
    """The wrapper of trees that come in the order of their shapes: those of one shape first, so it doesn't depend on how pages were dealt."""

    def __init__(self):
        self.done: Node | None = None
        self.shape, self.same = "", None

    def add(self, shape: str, tree: Node) -> None:
        if self.same is not None and shape == self.shape:
            _merge(self.same, tree)
        else:
            self.result()
            self.shape, self.same = shape, tree

    def result(self) -> Node | None:
        if self.same is not None:
            self.done = self.same if self.done is None else bounded(_merge(self.done, self.same))
            self.same = None
        return self.done


def merge_wrappers(trees: list[list]) -> Node:
    """The wrapper of packed trees."""
    fold = Fold()
    for n in sorted(map(Node.unpack, trees), key=Node.shape):
        fold.add(n.shape(), n)
    return fold.result()


def _folded(trees: DataFrame, by: list[str]) -> DataFrame:
    """``host, shape, tree``: one wrapper for the trees of each ``by``, which are streamed in the order of their shapes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, Fold()

        def out() -> pd.DataFrame:
            node = fold.result()
            return pd.DataFrame({"host": [key[0]], "shape": [node.shape()], "tree": [json.dumps(node.pack())]})

        for b in batches:
            for at, shape, tree in zip(zip(*[b[c] for c in by], strict=True), b["shape"], b["tree"], strict=True):
                if at != key:
                    if key is not None:
                        yield out()
                    key, fold = at, Fold()
                fold.add(shape, Node.unpack(json.loads(tree)))
        if key is not None:
            yield out()

    return trees.repartition(*by).sortWithinPartitions(*by, "shape").mapInPandas(run, "host string, shape string, tree string")


def expression(node: Node) -> str:
    """A wrapper as a regular expression without unions; ``#`` is a text slot, ``"`` a fixed text."""
    text = "" if not node.chars else "#" if node.text == "*" else '"'
    inside = text + "".join(expression(k) for k in node.kids)
    whole = f"<{node.sig}>{inside}</>"
    return f"({whole}){'*' if node.optional and node.many else '?' if node.optional else '+'}" if node.optional or node.many else whole


def _is_fixed(node: Node) -> bool:
    return bool(node.chars) and node.text != "*" and len(node.keys) >= FIXED_PAGES


def wrapper_rule(wrapper: Node) -> dict:
    """The region with most slot text, whether its main text is in semantic elements, and the fixed texts at their places.

    The last is a tree of kind, text and items, as far as the wrapper holds any.
    """
    volume: dict[int, tuple[int, int]] = {}  # of a node: text that changes, and the part of it in semantic elements
    known = len(wrapper.keys) >= FIXED_PAGES  # fewer contents say nothing about what changes

    def weigh(node: Node, in_main: bool) -> tuple[int, int]:
        if _named_boiler(node.sig, in_main):
            volume[id(node)] = 0, 0
            return 0, 0
        in_main = in_main or _semantic(_kind(node.sig))
        own = 0 if _is_fixed(node) or not (known or in_main) else node.chars * (SEMANTIC if in_main else 1)
        below = [weigh(k, in_main) for k in node.kids]
        volume[id(node)] = own + sum(v for v, _ in below), own * in_main + sum(v for _, v in below)
        return volume[id(node)]

    def places(node: Node, in_main: bool) -> list:
        if _named_boiler(node.sig, in_main):
            return [node.sig, "", []]
        in_main = in_main or _semantic(_kind(node.sig))
        kids = [places(k, in_main) for k in node.kids]
        return [node.sig, node.text if _is_fixed(node) else "", kids if any(k[1] or k[2] for k in kids) else []]

    def total(nodes: list[Node], part: int = 0) -> int:
        return sum(volume[id(n)][part] if id(n) in volume else 0 for n in nodes)

    weigh(wrapper, False)
    level, main = [wrapper], []
    while not (main and _semantic(main[-1])):
        kinds: dict[str, list[Node]] = {}
        for k in [k for n in level for k in n.kids]:
            kinds.setdefault(_kind(k.sig), []).append(k)
        best = max(kinds, key=lambda k: total(kinds[k]), default="")
        if not best or total(kinds[best]) < MAIN_SHARE * max(1, total(level)):
            break
        if not _semantic(best) and (any(k.many for k in kinds[best]) or not any(k.kids for k in kinds[best])):
            break
        level = kinds[best]
        main.append(best)
    return {"main": main, "semantic": total(level, 1) >= MAIN_SHARE * max(1, total(level)), "fixed": places(wrapper, False)}


def _host(url) -> str:
    return split_url(url if isinstance(url, str) else None)[0]


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, tree`` (the packed wrapper), one row a host, over all its pages."""

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], Node] = {}

        def out() -> pd.DataFrame:
            rows = [(h, xxhash.xxh32_intdigest(s) % 16, s, json.dumps(n.pack())) for (h, s), n in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["host", "salt", "shape", "tree"])

        for b in batches:
            for u, source in zip(b["url"], b["html"], strict=True):
                tree = tidy(Page(source if isinstance(source, str) else None).root)
                at = (_host(u), tree.shape())
                if at in held:
                    _merge(held[at], tree)
                else:
                    held[at] = tree
                if len(held) >= HELD_TREES:
                    yield out()
        if held:
            yield out()

    trees = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(of_task, "host string, salt int, shape string, tree string")
    return _folded(_folded(trees, ["host", "salt"]), ["host"]).select("host", "tree")


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "rule": [json.dumps(wrapper_rule(Node.unpack(json.loads(t)))) for t in b["tree"]]})

    known = saved(wrappers(pages, url, html).mapInPandas(rules, "host string, rule string"), "wrappers")

    @F.pandas_udf("string")
    def host_of(urls: pd.Series) -> pd.Series:
        return urls.map(_host)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [Page(s if isinstance(s, str) else None).main_text(json.loads(r) if isinstance(r, str) else None) for s, r in zip(b["html"], b["rule"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", host_of("url"))
    few = known.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    if few:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:  # every host's rule is dealt to 16 tasks, so that no host is one task's
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(16)))
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        joined = rows.join(dealt, ["host", "salt"], "left")
    return saved(joined.select("page_id", "url", "html", "rule").mapInPandas(texts, "page_id long, url string, text string, n_chars long"), "page-texts")
