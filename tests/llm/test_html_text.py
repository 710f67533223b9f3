"""Main text of pages without an article, and of pages whose wrappers have telling names."""

import pytest

from graphloom.llm.html_text import main_text

LONG = "Long words of the text, one after another. " * 12
ONE, TWO = ("First " + LONG).strip(), ("Second " + LONG).strip()
MENU = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
SIDE = "<div class='sidebar'><a href=3>More</a> to read</div>"
PAGES = {
    "text in body, between inline tags and br": (f"<body>{MENU}<div><p>{ONE}</p><p>{TWO}</p></div>A bare <b>bold</b> end<br>of text.<div class=ad>Buy this</div></body>", f"{ONE} {TWO} A bare bold end of text."),
    "bare text before and after": (f"<body>Before.<p>{ONE}</p>After <a href=x>a link</a> comes more text.</body>", f"Before. {ONE} After a link comes more text."),
    "links in body are a menu": (f"<body><a href=1>Home page</a> | <a href=2>News page</a><div><p>{ONE}</p><p>{TWO}</p></div></body>", f"{ONE} {TWO}"),
    "wrapper has-sidebar, no article": (f"<body>{MENU}<div class='content has-sidebar'><p>{ONE}</p><p>{TWO}</p>{SIDE}</div></body>", f"{ONE} {TWO}"),
    "wrapper around the article": (f"<body>{MENU}<div id='page-header-menu'><div class='sidebar-layout'><article><p>{ONE}</p></article></div>{SIDE}</div></body>", ONE),
    "most text in a marked wrapper": (f"<body>{MENU}<div class='sidebar-right'><p>{ONE}</p><p>{TWO}</p></div>{SIDE}</body>", f"{ONE} {TWO}"),
    "post-header in an article": (f"<body><article><div class='post-header'><h1>Title</h1></div><p>{ONE}</p>{SIDE}</article></body>", f"Title {ONE}"),
    "most of an article in a marked wrapper": (f"<body><article><h1>Title</h1><div class='banner-layout'><p>{ONE}</p></div></article></body>", f"Title {ONE}"),
    "comments-open": (f"<body><div class='post comments-open'><p>{ONE}</p></div></body>", ONE),
    "comments longer than the article, as articles": (f"<body><article><p>{ONE}</p><div class='comments'><article><p>{TWO} {TWO}</p></article></div></article></body>", ONE),
    "advert longer than the article": (f"<body>{MENU}<div class='ad'>{TWO}</div><article><h1>Title</h1><p>Short.</p></article></body>", "Title Short."),
    "comments beside the article": (f"<body><main><p>{ONE} {TWO}</p></main><div id='comments'><article><p>{TWO}</p></article></div></body>", f"{ONE} {TWO}"),
    "a notice whose end tag is left out": (f"<body><article><p class='notice'>Ad<p>{ONE}<ul><li class='share'>Share<li>{TWO}</ul></article>", f"{ONE} {TWO}"),
    "comments-free": (f"<body><div class='comments-free'><p>{ONE}</p><p>{TWO}</p></div></body>", f"{ONE} {TWO}"),
    "math in running text": (f"<body><article><p>{ONE} <math><mi>x</mi></math> more.</p></article></body>", f"{ONE} x more."),
    "a role whose end tag is left out": (f"<body><article><p role='alert'>Careful<p>{ONE}</article>", ONE),
    "a head whose end tag is left out": (f"<html><head><title>t</title><meta charset=utf-8><body><p>{ONE}</p><p>{TWO}</p></body>", f"{ONE} {TWO}"),
    "links inside the article": (f"<body><article><h1><a href=x>Title</a></h1><div><p>{ONE}</p><p>{TWO}</p></div><ul><li><a href=1>Another page</a></li><li><a href=2>And one more</a></li></ul></article></body>", f"Title {ONE} {TWO}"),
    "two articles": (f"<body><article><p>{ONE}</p><p>{TWO}</p></article><article><p>Short one.</p></article></body>", f"{ONE} {TWO}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_deep_pages_take_linear_time():
    assert main_text("<div class='sidebar'>" * 5000 + f"<p>{ONE}</p>") == ONE


def _densities(root, voids):
    """Composite text density of each node and the sum over its children, by recursion over the definition."""
    import math

    from graphloom.llm.html_text import Node

    def count(node, tag=None):
        return sum(count(x, tag) + (tag is None or x.tag == tag) for x in node.items if isinstance(x, Node)) + voids[id(node)] * (tag is None)

    def chars(node, inside=False):
        return sum(chars(x, inside or x.tag == "a") if isinstance(x, Node) else len("".join(x.replace(" ", "").split("\n"))) for x in node.items)

    def link_chars(node):
        return chars(node) if node.tag == "a" else sum(link_chars(x) for x in node.items if isinstance(x, Node))

    whole = link_chars(root) / max(chars(root), 1)

    def density(node):
        c, lc = chars(node), link_chars(node)
        if not c:
            return 0.0
        t, lt = max(count(node), 1), max(count(node, "a"), 1)
        outer = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / lt + 1e-9) / max(math.log(outer + 1e-9), 1.0)

    return density, lambda node: sum(density(x) for x in node.items if isinstance(x, Node))


def test_density_against_its_definition(spark, sf_dir):
    """On every page the chosen core has the largest density sum, and the sums decide it on pages with several candidates."""
    from graphloom.llm import html_text

    decided = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain, root = html_text.parse(r.html or ""), html_text.parse(r.html or "")
        density, total = _densities(plain, {id(node): node.tags for node in html_text._walk(plain)})
        pairs = list(zip(html_text._walk(plain), html_text._measure(root)))
        for a, b in pairs:
            assert abs(density(a) - b.density) <= 1e-9 * max(1, b.density) and abs(total(a) - b.total) <= 1e-9 * max(1, b.total)
        sums = sorted((b.total for _, b in pairs), reverse=True)
        decided += len(sums) > 1 and sums[0] > sums[1] > 0
    assert decided


def test_density_finds_articles_without_their_tag(spark, sf_dir):
    pages = [r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    same = sum(main_text(p) == main_text(p.replace("<article", "<div").replace("</article", "</div")) for p in pages)
    assert same >= 0.95 * len(pages)
