"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Each paragraph earns points for its
length and commas and passes them to its ancestors, less to farther ones; an
element's points are discounted by the share of its text that is link text. The
best element is the article, with those siblings that also hold prose. Elements
that by name, class or role are menus, forms, notices, adverts, reader comments
or page furniture are cut before scoring. A cut by class, id or role is taken
back where it took the page's article.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element names by their part in a page.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary header footer nav aside form fieldset hgroup center "
    "search menu dialog".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select button xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("nav footer aside form fieldset menu dialog search".split())
ARTICLES = frozenset(("article", "main"))
#: Parts of class names, ids and roles that mark what is not the article, and what is.
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar rail widget "
    "related recommended recommendations share sharing social nav navbar navigation menu breadcrumb breadcrumbs footer "
    "comment comments disqus reply replies respond discussion form search pagination pager toolbar complementary "
    "contentinfo dialog masthead outbrain taboola skip".split()
)
HEADER_NAMES = frozenset(("header", "topbar"))
GOOD_NAMES = frozenset("article content post entry story text body main prose".split())
#: Points: paragraph, per 100 characters (at most 3), start of an element by kind.
KIND_POINTS = {"article": 25.0, "main": 15.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}
GOOD_POINTS = 15.0
#: Share of link text from which a list counts as a menu, and a sibling's least share of points.
MENU_LINKS, SIBLING_SHARE, SIBLING_LEAST = 0.6, 0.2, 10.0
#: How sure a name cut is: by part of a class name, by a whole one, or reader comments.
WEAK, STRONG, COMMENTS = 1, 2, 3
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond discussion".split())
#: Share of the page's prose that is most of it, and of an element's prose that is little.
MOST, LITTLE = 0.5, 0.25

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PART = re.compile(r"[a-z]+")
#: Elements that an opening tag ends, and those it does not look beyond.
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
}


class _Node:
    __slots__ = ("tag", "parent", "hidden", "named", "cut", "points", "chars", "links", "good")

    def __init__(self, tag: str, parent: _Node | None, hidden: bool, named: int, good: bool):
        self.tag, self.parent, self.hidden, self.named, self.good = tag, parent, hidden, named, good
        self.cut = hidden or bool(named) or parent is not None and parent.cut
        self.clear()

    def clear(self) -> None:
        self.points = KIND_POINTS.get(self.tag, 0.0) + GOOD_POINTS * self.good
        self.chars = self.links = 0

    def inside(self, tags: frozenset[str]) -> bool:
        return self.within(tags) is not None

    def within(self, tags: frozenset[str]) -> _Node | None:
        node: _Node | None = self
        while node and node.tag not in tags:
            node = node.parent
        return node

    @property
    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0

    @property
    def score(self) -> float:
        return self.points * (1.0 - self.density)


def _open(tag: str, attributes: str, parent: _Node) -> _Node:
    hidden, named = parent.hidden or tag in CUT, 0
    names: set[str] = set()
    whole: set[str] = set()
    known: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in known:
            continue
        known.add(name)
        if name in ("class", "id", "role"):
            names.update(_PART.findall(value))
            whole.update(value.split())
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    if tag not in ("html", "body") and tag not in ARTICLES:
        if not CUT_NAMES.isdisjoint(names):
            named = WEAK if CUT_NAMES.isdisjoint(whole) else STRONG
        if (tag == "header" or not HEADER_NAMES.isdisjoint(names)) and not parent.inside(ARTICLES):
            named = named or WEAK
        if named and not COMMENT_NAMES.isdisjoint(names):
            named = COMMENTS
    elif tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(names):
        named = COMMENTS
    return _Node(tag, parent, hidden, named, not GOOD_NAMES.isdisjoint(names))


def _restored(blocks: list[tuple[_Node, str, int]], found: int) -> bool:
    """Takes name cuts back that took the article, given the characters found; whether any.

    Such an element holds the only article or main elements of the page and more
    than was found, or most of the prose where little or nothing was found. Reader
    comments stay cut.
    """
    prose: dict[_Node, int] = {}
    holding: set[_Node] = set()
    whole, outside = 0, False
    for element, text, linked in blocks:
        names: list[_Node] = []
        article = False
        node: _Node | None = element
        while node:
            if node.named:
                names.append(node)
            elif node.tag in ARTICLES and not names:
                article = True
            node = node.parent
        if any(n.named == COMMENTS for n in names):
            continue
        whole += len(text) - linked
        for node in names:
            prose[node] = prose.get(node, 0) + len(text) - linked
        if article:
            holding.update(names)
            outside = outside or not names
    taken = []
    for node, chars in prose.items():
        only = node in holding and not outside and found < chars
        little = not found or node.named == WEAK and found < LITTLE * chars
        if only or little and chars > MOST * whole:
            taken.append(node)
    for node in taken:
        node.named = 0
    return bool(taken)


def _blocks(html: str) -> list[tuple[_Node, str, int]]:
    """Blocks of text in page order: element, text, and characters of link text."""
    root = _Node("html", None, False, 0, False)
    here, link = root, False
    out: list[tuple[_Node, str, int]] = []
    text: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append((here, whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not here.hidden:
            text.append(raw)
            if link:
                linked += len(raw.strip())

    at = 0
    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag == "a":
            link = not closing
        elif tag in VOID:
            add(" ")
        elif tag in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else len(html)
        elif tag == "head":
            continue
        elif tag in BLOCKS:
            if closing:
                node: _Node | None = here
                while node and node.tag != tag:
                    node = node.parent
                if tag == "p" and node is None:
                    end_block()
                elif node and node.parent:
                    end_block()
                    here, link = node.parent, False
            else:
                end_block()
                if (p := _nearest(here, frozenset(("p",)), frozenset(("td", "th", "table", "button")))) is not None:
                    here = p.parent
                if tag in _ENDS and (old := _nearest(here, *_ENDS[tag])) is not None:
                    here = old.parent
                if tag not in ("html", "body"):
                    here = _open(tag, m[3] or m[6] or "", here)
        # other elements are inline: their text belongs to the block around them
    add(html[at:])
    end_block()
    return out


def _nearest(node: _Node | None, tags: frozenset[str], limit: frozenset[str]) -> _Node | None:
    while node and node.tag not in tags:
        if node.tag in limit:
            return None
        node = node.parent
    return node if node and node.parent else None


def _score(blocks: list[tuple[_Node, str, int]]) -> None:
    for element, _, _ in blocks:
        node: _Node | None = element
        while node:
            node.clear()
            node = node.parent
    for element, text, linked in blocks:
        node = element
        while node:
            node.chars += len(text)
            node.links += linked
            node = node.parent
    for element, text, linked in blocks:
        heading = element.tag[0] == "h" and element.tag[1:].isdigit()
        points = (0.0 if heading else 1.0) + text.count(",") + min(len(text) / 100.0, 3.0)
        points *= 1.0 - linked / len(text)
        # A text that stands in a container directly counts for the container itself.
        node = element if element.tag in KIND_POINTS else element.parent
        share = 1.0
        step = 0
        while node:
            node.points += points * share
            step += 1
            share = 0.5 if step == 1 else 1.0 / (3 * step)
            node = node.parent


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line ends; empty for a page without any."""
    if not html:
        return ""
    blocks = _blocks(html)
    text = _article([b for b in blocks if not b[0].cut])
    if any(b[0].cut for b in blocks) and _restored(blocks, len(text)):
        text = _article([b for b in blocks if not _is_cut(b[0])])
    return text


def _is_cut(node: _Node) -> bool:
    step: _Node | None = node
    while step and not step.named:
        step = step.parent
    return step is not None


def _article(blocks: list[tuple[_Node, str, int]]) -> str:
    if not blocks:
        return ""
    _score(blocks)
    every = blocks
    menus: dict[_Node, bool] = {}

    def menu(node: _Node) -> bool:
        found = node.within(frozenset(("ul", "ol")))
        if found is None:
            return False
        if found not in menus:
            menus[found] = found.density > MENU_LINKS
        return menus[found]

    blocks = [b for b in blocks if not menu(b[0])]
    if not blocks:
        return ""
    candidates: dict[_Node, None] = {}
    for element, _, _ in blocks:
        node: _Node | None = element if element.tag in KIND_POINTS else element.parent or element
        while node:
            candidates[node] = None
            node = node.parent
    best = max(candidates, key=lambda n: n.score)
    best = best.within(ARTICLES) or best
    floor = max(SIBLING_LEAST, SIBLING_SHARE * best.score)

    def kept(node: _Node, text: str, linked: int) -> bool:
        step: _Node | None = node
        while step and step is not best:
            if step.parent is best.parent and step.parent is not None:
                if step.tag == "p":
                    density = linked / len(text)
                    return len(text) > 80 and density < 0.25 or not linked and text[-1] in ".!?"
                if best.tag in ARTICLES and step.tag not in ARTICLES:
                    return False
                return step.score >= floor
            step = step.parent
        return step is best

    def listed(node: _Node) -> bool:
        """Whether a list of links is part of the article: navigation was cut before."""
        step: _Node | None = node
        while step and step is not best:
            step = step.parent
        return step is best and best.tag not in ("html", "body")

    return "\n".join(
        text for node, text, linked in every if kept(node, text, linked) and (not menu(node) or listed(node))
    )


def extracted(html: Column) -> Column:
    """Main text of an html column; never null."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return run(html)
