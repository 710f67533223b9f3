"""Operator 9: main text of HTML pages by composite text density.

Each page becomes a DOM tree without the elements whose tag, role, class or id
marks them as menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments. A class or id does not remove what holds the main
article or (reader comments apart) most of its text outside links, on a page
without articles most of the page's; nor do names such as has-sidebar or
comments-open. For every node the density is its characters per tag,
adjusted by the share of link text; the density sum of a node adds up the
densities of its children. The node with the largest sum (the first one on ties) is
the core. The lowest density on the path from the core up to the body is the
threshold. What stands beside the path joins the core: in the body, or around an
article if the path has one, subtrees whose density reaches the threshold; nearer to
the core others, too, but for blocks of several links that are links for the most
part; and text between them that is not links for the most part. Nothing outside an
article on the path joins it.

Defined cases: a null or empty page has the empty text; a page cut off inside a
tag loses that tag only; unclosed elements end with their parent; very long pages
take time in proportion to their length; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.shared import bounded_batches

_WORDS = str.split
RAW = set(_WORDS("script style noscript template iframe object svg textarea title select canvas audio video"))
VOID = set(_WORDS("area base br col embed hr img input link meta param source track wbr"))
SKIP = set(_WORDS("nav footer aside form button dialog menu fieldset label option datalist")) | RAW
INLINE = set(_WORDS("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img"))
MARKS = set(_WORDS("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead header topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager skip disclaimer"))
COMMENTS = set(_WORDS("comment comments disqus reply replies respond"))
#: Last parts of names of what holds reader comments.
HOLDERS = COMMENTS | set(_WORDS("list section area thread form wrapper container box"))
#: First and last parts of names that tell what a page has, not what an element is.
HAS, STATES = set(_WORDS("has no with without")), set(_WORDS("open closed enabled disabled"))
ROLES = set(_WORDS("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form"))
CORE = {"article", "main"}
#: An open element of the key ends where one of these starts.
ENDS = {"p": set(_WORDS("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul")), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
STOPS = {"p": {"td", "th", "table", "li", "article", "section", "div", "body"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z0-9]+").findall


def _unwanted(tag: str, attributes: str, inside_core: bool) -> int:
    """0 for wanted elements, 1 for unwanted ones; 2 and, for reader comments, 3 where only a class or id says so; 4 for unwanted roles."""
    if tag in SKIP or tag == "header" and not inside_core:
        return 1
    if "=" not in attributes or tag in ("html", "body") or tag in CORE:
        return 0
    out = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in ROLES:
                return 4
            continue
        for word in value.split():
            parts = _PARTS(word)
            marks = MARKS.intersection(parts) - ({"header"} if inside_core else set())
            if marks and parts[0] not in HAS and parts[-1] not in STATES:
                out = max(out, 3 if marks & COMMENTS and parts[-1] in HOLDERS else 2)
    return out


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked")

    def __init__(self, tag: str, parent: "Node | None") -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.marked = 0


def parse(page: str) -> Node:
    """DOM tree of a page, without unwanted elements."""
    root = Node("body", None)
    at, pos, size = root, 0, len(page)
    depth_core, skipping, open_skipped = 0, "", 0
    while pos < size:
        found = _TAG.search(page, pos)
        if found is None:
            if not skipping:
                at.items.append(page[pos:])
            break
        if found.start() > pos and not skipping:
            at.items.append(page[pos : found.start()])
        pos = found.end()
        tag = (found[2] or found[6] or "").lower()
        if not tag or not (found[4] or found[8]):
            continue  # a comment, a declaration, or a tag cut off
        closing, attributes = found[1] or found[5], found[3] or found[7] or ""
        if skipping:
            if tag == skipping:
                open_skipped += -1 if closing else 0 if attributes.endswith("/") else 1
                if not open_skipped:
                    skipping = ""
            elif not closing and tag in RAW and tag not in VOID:
                pos = _after(page, pos, tag)
            continue
        if closing:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node is not root:
                depth_core -= _cores(at, node.parent)
                at = node.parent
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in VOID:
            Node(tag, at)
            at.items.append(" " if tag in ("br", "hr") else "")
            at.tags += 1
            continue
        for kind, starts in ENDS.items():
            if tag in starts:
                node = at
                while node is not root and node.tag != kind and node.tag not in STOPS[kind]:
                    node = node.parent
                if node is not root and node.tag == kind:
                    depth_core -= _cores(at, node.parent)
                    at = node.parent
        marked = _unwanted(tag, attributes, depth_core > 0)
        if marked == 1:
            if tag in RAW:
                pos = _after(page, pos, tag)
            elif not attributes.endswith("/"):
                skipping, open_skipped = tag, 1
            continue
        node = Node(tag, at)
        node.marked = marked
        at.items.append(node)
        if not attributes.endswith("/"):
            at = node
            depth_core += tag in CORE
    _prune(root)
    return root


def _cores(low: Node, high: Node | None) -> int:
    n = 0
    while low is not high:
        n += low.tag in CORE
        low = low.parent
    return n


_CLOSE: dict[str, re.Pattern] = {}


def _after(page: str, pos: int, tag: str) -> int:
    """Where the raw text of an element ends."""
    found = _CLOSE.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>", re.I)).search(page, pos)
    return found.end() if found else len(page)


def _walk(root: Node) -> list[Node]:
    """Nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def _size(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def _prune(root: Node) -> None:
    """Takes marked elements out, but for those that hold the main article, or most of its text (of the page's where there is no article)."""
    nodes = _walk(root)
    if not any(node.marked for node in nodes):
        return
    size: dict[int, int] = {}
    for node in reversed(nodes):
        size[id(node)] = 0 if node.tag == "a" else sum(size[id(x)] if isinstance(x, Node) else _size(x) for x in node.items)
    core = {}  # the outermost article around a node
    for node in nodes:
        core[id(node)] = core.get(id(node.parent)) or (node if node.tag in CORE else None)
    main = max((node for node in nodes if core[id(node)] is node), key=lambda node: size[id(node)], default=None)
    holds, node = set(), main
    while node is not None:
        holds.add(id(node))
        node = node.parent

    def gone(node: Node) -> bool:
        beside = core[id(node)] is not main  # never of a page without articles
        return node.marked == 4 or node.marked > 0 and id(node) not in holds and (beside or node.marked == 3 or 2 * size[id(node)] <= size[id(main or root)])

    for node in nodes:
        node.items = [x for x in node.items if not isinstance(x, Node) or not gone(x)]


def _measure(root: Node) -> list[Node]:
    nodes = _walk(root)
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += _size(x)
    for node in nodes:
        c, lc = node.chars, node.chars if node.tag == "a" else node.link_chars
        if c:
            t, lt = max(node.tags, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - lc, 1) * lc + root.link_chars / max(root.chars, 1) * c + math.e)
            node.density = c / t * math.log(c / max(lc, 1) * t / lt + 1e-9) / max(math.log(base + 1e-9), 1.0)
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def _links(x: Node | str) -> int:
    """Characters of links."""
    return 0 if isinstance(x, str) else x.chars if x.tag == "a" else x.link_chars


def _chars(x: Node | str) -> int:
    return _size(x) if isinstance(x, str) else x.chars


def _beside(items: list[Node | str], low: float, outermost: bool) -> list[Node | str]:
    """Of neighbours of the path those that join the core."""
    out: list[Node | str] = []
    for bare, run in groupby(items, lambda x: isinstance(x, str) or x.tag in INLINE):
        run = list(run)
        if bare and any(isinstance(x, str) and x.strip() for x in run) and 2 * sum(map(_links, run)) <= sum(map(_chars, run)):
            out += run
            continue
        for x in run:
            if isinstance(x, Node) and (x.density >= low or not outermost and (x.link_tags < 2 or 2 * _links(x) <= x.chars)):
                out.append(x)
    return out


def _chosen(root: Node) -> list[Node | str]:
    """The subtrees that make up the main text, in page order."""
    nodes = _measure(root)
    core = max(nodes, key=lambda n: n.total)
    if core.total <= 0 or core is root:
        return [root]
    path, low = [core], core.density
    while path[-1].parent is not root:
        path.append(path[-1].parent)
        low = min(low, path[-1].density)
    articles = [k for k, node in enumerate(path) if node.tag in CORE]
    if articles:
        path = path[: articles[-1] + 1]
    before: list[Node | str] = []
    after: list[list[Node | str]] = []
    for below, node in reversed(list(zip(path, [*path[1:], path[-1].parent]))):
        if articles and below is path[-1]:
            continue
        at = next(k for k, x in enumerate(node.items) if x is below)
        before += _beside(node.items[:at], low, node is root)
        after.append(_beside(node.items[at + 1 :], low, node is root))
    return [*before, core, *(x for part in reversed(after) for x in part)]


def _blocks(node: Node, out: list[list[str]]) -> None:
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(html.unescape(x) if "&" in x else x)
        elif x.tag in INLINE:
            todo += reversed(x.items)
        else:
            out.append([])
            todo.append(None)
            todo += reversed(x.items)


def main_text(page: str | None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    out: list[list[str]] = [[]]
    for node in _chosen(parse(page)):
        _blocks(node, out)
    return " ".join(text for block in out if (text := " ".join("".join(block).split())))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars (code points of the text), one row per input row."""
    bounded_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
