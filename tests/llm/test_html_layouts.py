"""Pages of many layouts against what a reader would call their text; the parts are known, so nothing else is right."""

import itertools

import pytest

pytest.importorskip("factgraph.llm")
from factgraph.llm import html_text, queries  # noqa: E402

LONG = "".join(f"<p>Paragraph {i}, with text, that goes on and on for a while.</p>" for i in range(6))
TEXT = "\n\n".join(f"Paragraph {i}, with text, that goes on and on for a while." for i in range(6))
OTHERS = "".join(f"<p>Reader {i} says, well, this is a comment of some length, and more.</p>" for i in range(20))

CASES = {
    "comments longer than the text": (f'<div id="content">{LONG}</div><div class="comments">{OTHERS}</div>', TEXT),
    "advert longer than the text": (f'<div>{LONG}</div><div class="advert">{OTHERS}</div>', TEXT),
    "form around the page": (f'<form id="aspnetForm"><div>{LONG}</div><input value=x><select><option>o</option></select></form>', TEXT),
    "form around an article": (f"<form><article>{LONG}</article></form>", TEXT),
    "search form": (f"<div>{LONG}</div><form><p>Search, here.</p></form>", TEXT),
    "short second div": (f"<div>{LONG}</div><div>Small.</div>", TEXT + "\n\nSmall."),
    "short second section": (f'<div id="a"><section>{LONG}</section><section><p>Small.</p></section></div>', TEXT + "\n\nSmall."),
    "deep short section": (f"<div><section><div>{LONG}</div></section><section><div><p>Small.</p></div></section></div>", TEXT + "\n\nSmall."),
    "short article in main": (f"<main><article>{LONG}</article><article>Small.</article></main>", TEXT + "\n\nSmall."),
    "short sibling article": (f"<article>{LONG}</article><article>Small.</article>", TEXT + "\n\nSmall."),
    "lists of links": (f"<div><a href=x>one</a> <a href=y>two</a></div><div>{LONG}</div><ul><li><a href=z>z</a></li></ul>", TEXT),
    "nothing but comments": ('<div class="comments"><p>All, there is.</p></div>', "All, there is."),
    "named wrapper": (f'<div class="widget">{LONG}</div>', TEXT),
    "comments as articles": (f'<article>{LONG}<section id="comments"><article>{OTHERS}</article></section></article>', TEXT),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    body, want = CASES[name]
    assert html_text.extract(f"<html><head><title>t</title></head><body>{body}</body></html>") == want


CHROME = ["<nav><ul><li><a href=a>A</a></li></ul></nav>", "<header><p>Site</p></header>", "<footer><p>Foot, note.</p></footer>", "<aside><p>Aside, text.</p></aside>", '<div class="sidebar"><p>Side, bar.</p></div>', '<div class="cookie-notice">We use, cookies.</div>', "<script>var a, b;</script>", f'<section class="comments">{OTHERS}</section>', '<div class="ad">Buy, now.</div>', "<form><p>Sign up, now.</p></form>"]
#: Around the blocks of the text: how many go into each of two containers, and what the containers are.
SHAPES = ["<article>{0}{1}</article>", "<main>{0}{1}</main>", "<div>{0}{1}</div>", "<div><section>{0}</section><section>{1}</section></div>", "<main><article>{0}</article><article>{1}</article></main>", "<div id=a><div>{0}</div></div><div id=b><div>{1}</div></div>", "<div class=post><div>{0}{1}</div></div>"]


@pytest.mark.parametrize("shape", SHAPES)
def test_text_and_nothing_else(shape):
    """Every cut of the blocks, with every piece of chrome before and behind."""
    blocks = [f"<{t}>Block {i}, of the text, with words.</{t}>" for i, t in enumerate(["p", "h2", "p", "blockquote", "p"])]
    want = "\n\n".join(f"Block {i}, of the text, with words." for i in range(5))
    for cut, (before, after) in itertools.product((1, 3, 4), itertools.product(CHROME, repeat=2)):
        page = f"<body>{before}{shape.format(''.join(blocks[:cut]), ''.join(blocks[cut:]))}{after}</body>"
        assert html_text.extract(page) == want, page


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", "x", 1), (1, "u", f"<p>{LONG}", "x", 1), (None, None, None, "x", 2), (2, "v", "", "x", 3), (3, "w", "<p>" + "long text, " * 50_000, "x", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", ("long text, " * 50_000).strip(), 550_000 - 1)], key=str)
    assert html_text.extract_text(pages.where("false")).count() == 0
    assert {"page_id", "url", "text", "n_chars"} == set(queries.op8_html_text(spark, "/root/testdata/sf0.001").columns)
