"""Main text of web pages by tree scoring.

Paragraphs give points for their length and their commas to their ancestors, less with each level; an
ancestor's points are discounted by the share of its text that is inside links. The ancestor with
most points is the container; siblings that score well beside it are kept with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import even

# Element names and the words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template textarea title xmp iframe noembed noframes nav aside footer "
    "form button select option input label dialog menu object applet canvas svg math audio video".split()
)
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner banners breadcrumb breadcrumbs "
    "combx comment comments commentlist consent contentinfo cookie cookies discussion disqus footer gdpr "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination paywall popup promo promos promotion recommendations recommended related remark replies "
    "reply respond rss search share sharing shoutbox sidebar signup social sponsor sponsored subscribe "
    "subscription tags toolbar widget widgets alert alertdialog complementary".split()
)
# Words of MARKS that also name parts of a text: kept in its flow if they are no links and no controls,
# those of the second line if they are long as well.
SAID = frozenset("discussion search related remark reply alert".split())
SAID_IF_LONG = frozenset(
    "banner comment menu menus navigation notice notices overlay promotion recommendations recommended share "
    "sharing social sponsor subscription tags toolbar".split()
)
LONG = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("form input select textarea button".split())
LAYOUT = frozenset("has with no without".split())
HEADER = frozenset("header head topbar".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption div section".split())
CLOSES_LIKE = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"),
    "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
SCOPES = frozenset("table td th ul ol dl article section main div body button select".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = (
        "tag", "attributes", "parent", "children", "points", "chars", "linked", "has_main", "is_page", "is_most",
        "raw", "raw_linked", "controls",
    )

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = self.raw = self.raw_linked = 0
        self.controls = False
        self.has_main = self.is_page = self.is_most = False


def parse(html: str) -> Node:
    """The page's elements and texts; open elements are closed the way browsers do, roughly."""
    root = here = Node("html")
    at = 0
    while True:
        token = TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        if text:
            here.children.append(unescape(text))
        if not token:
            return root
        at = token.end()
        if token[1]:
            here.children.append(token[1])
        name = token[3] or token[6]
        if not name:
            continue
        tag = name.lower()
        if token[2] or token[5]:
            here = _close(here, tag)
        elif tag == "html":
            root.attributes = token[4] or token[7] or ""
        else:
            here = _make_room(here, tag)
            node = Node(tag, token[4] or token[7] or "", here)
            here.children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            elif tag not in VOID:
                here = node


def _close(here: Node, tag: str) -> Node:
    node: Node | None = here
    while node is not None and node.tag != tag:
        # An inline end tag does not reach through the block that it stands in.
        node = None if tag not in BLOCK and node.tag in BLOCK else node.parent
    return node.parent if node is not None and node.parent is not None else here


def _make_room(here: Node, tag: str) -> Node:
    """Close what the start of an element ends: an open paragraph, list item or cell."""
    ends = ("p",) if tag in BLOCK else ()
    for targets in (ends, CLOSES_LIKE.get(tag, ())):
        node: Node | None = here
        while targets and node is not None:
            if node.tag in targets:
                here = node.parent or here
                break
            if node.tag in SCOPES:
                break
            node = node.parent
    return here


def _marked(node: Node, in_article: bool) -> bool:
    """True if the element's name, class, id or role says that it is no main text."""
    # A form around the page or its article is a plain container; its controls are dropped for themselves.
    if node.tag in DROPPED and not (node.tag == "form" and (node.has_main or node.is_page or node.is_most)):
        return True
    if node.tag == "header":
        return not in_article
    if not node.attributes or node.tag in ("html", "body", "main") or node.has_main:
        return False
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(node.attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for word in value.strip("\"'").split():
                parts = [p.lower() for p in NAME_PART.findall(word)]
                # "has-sidebar" names the layout that the element holds, not the element.
                if not parts or parts[0] in LAYOUT:
                    continue
                words.update(MARKS.intersection(parts))
                if not in_article:
                    words.update(HEADER.intersection(parts))
    # A heading goes only with the element that it heads.
    if not words or node.is_page or node.tag in HEADINGS:
        return False
    return not _is_said(node, words, in_article)


def _is_said(node: Node, words: set[str], in_article: bool) -> bool:
    """True if the words that mark an element may as well name a part of the text that it stands in."""
    if not words <= SAID and not (words <= SAID | SAID_IF_LONG and node.raw >= LONG):
        return False
    if node.controls or node.raw_linked * 10 >= node.raw * 3:
        return False
    beside = [c.tag for c in node.parent.children if isinstance(c, Node)] if node.parent else []
    return in_article or "h1" in beside or beside.count("p") > 1


def _find_main(root: Node) -> None:
    """Mark the elements that hold an article or main element, most of the text, or the heading with it."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and (c.tag == "form" or c.tag not in DROPPED))
        node.controls = any(isinstance(c, Node) and c.tag in CONTROLS for c in node.children)
    size = {id(n): sum(len(c) for c in n.children if isinstance(c, str)) for n in nodes}
    headed: set[int] = set()
    for node in reversed(nodes):
        up = node.parent
        node.raw = size[id(node)]
        if node.tag == "a":
            node.raw_linked = node.raw
        if up is None:
            continue
        up.raw_linked += node.raw_linked
        up.controls |= node.controls
        size[id(up)] += size[id(node)]
        up.has_main |= node.has_main or node.tag in ("article", "main")
        if node.tag == "h1" or id(node) in headed:
            headed.add(id(up))
    for node in nodes:
        node.is_most = 2 * size[id(node)] > size[id(root)]
        node.is_page = id(node) in headed and node.is_most


def _prune(root: Node) -> list[Node]:
    """Take boilerplate elements out; the elements that are left, parents first."""
    kept, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        kept.append(node)
        in_article = in_article or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _marked(c, in_article)]
        stack.extend((c, in_article) for c in reversed(node.children) if isinstance(c, Node))
    return kept


def _score(nodes: list[Node]) -> None:
    """Sum up text and link text, then pass each paragraph's points to its ancestors."""
    own: dict[int, str] = {}
    for node in reversed(nodes):
        own[id(node)] = " ".join(c for c in node.children if isinstance(c, str))
        node.chars += len(" ".join(own[id(node)].split()))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:
        if node.tag not in PARAGRAPHS or not node.chars:
            continue
        # A paragraph's text is that of its inline elements, too.
        text, stack = [], [node]
        while stack:
            n = stack.pop()
            text.append(own[id(n)])
            stack.extend(c for c in n.children if isinstance(c, Node) and c.tag not in BLOCK)
        said = " ".join("".join(text).split())
        if not said:
            continue
        points = (1 + said.count(",") + min(len(said) / 100, 10)) * (1 - node.linked / node.chars)
        up, level = node.parent, 1
        while up is not None and level <= 5:
            up.points += points / level
            up, level = up.parent, level + 1


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _container(nodes: list[Node]) -> Node | None:
    best, most = None, 0.0
    for node in nodes:
        if node.tag == "html" or not node.chars:
            continue
        points = node.points * (1 - _density(node))
        if points > most:
            best, most = node, points
    if best is None:
        return next((n for n in nodes if n.tag == "body" and n.chars), nodes[0])
    # The main element, else the article, that the container is a part of is the container.
    up, article, main = best, None, None
    while up is not None:
        article = up if up.tag == "article" else article
        main = up if up.tag == "main" else main
        up = up.parent
    return main or article or best


def _without_links(container: Node) -> None:
    """Take out of a main element what is little but links and stands outside its articles."""
    stack = [container]
    while stack:
        node = stack.pop()
        node.children = [
            c
            for c in node.children
            if isinstance(c, str) or c.tag not in BLOCK or c.tag in HEADINGS or _density(c) < 0.5 or not c.linked
        ]
        stack.extend(c for c in node.children if isinstance(c, Node) and c.tag in ("div", "section"))


def _with_siblings(container: Node) -> list[Node | str]:
    """The container and what belongs to it beside it: headings, bare text, articles and good blocks."""
    parent = container.parent
    if container.tag == "main":
        _without_links(container)
    if parent is None or container.tag == "main":
        return [container]
    least = max(container.points * (1 - _density(container)) * 0.2, 3)
    kept: list[Node | str] = []
    for child in parent.children:
        if isinstance(child, str):
            kept.append(child)
            continue
        long_text = child.tag in ("p", "pre", "blockquote") and child.chars >= 80 and _density(child) < 0.25
        same = child.points * (1 - _density(child)) >= least and _density(child) < 0.5
        own = (child.tag in HEADINGS or child.tag == "article") and _density(child) < 0.5
        inline = child.tag not in BLOCK and parent.tag != "body" and _density(child) < 0.5
        if child is container or long_text or same or own or inline:
            kept.append(child)
        elif child.tag in BLOCK:
            # What is left out still parts the texts before and after it.
            kept.append(Node("hr"))
    return kept


def _blocks(nodes: list[Node | str]) -> list[str]:
    """The texts of blocks in page order."""
    found: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            found.append(text)

    stack: list = [(n, False) for n in reversed(nodes)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            words.append(node)
        elif leaving or node.tag == "hr":
            flush()
        elif node.tag == "br":
            words.append(" ")
        else:
            if node.tag in BLOCK:
                flush()
                stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    flush()
    return found


def main_text(html: str | None) -> str:
    """The page's main text: blocks joined by an empty line; empty for a null or empty page."""
    if not html:
        return ""
    root = parse(html)
    _find_main(root)
    nodes = _prune(root)
    _score(nodes)
    container = _container(nodes)
    return "\n\n".join(_blocks(_with_siblings(container)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A page without main text has an empty text. Repeated rows keep their rows, nulls in page_id and
    url stay, other columns are ignored, and an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame(
                {
                    "page_id": frame["page_id"],
                    "url": frame["url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                }
            )

    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return even(slim).mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
