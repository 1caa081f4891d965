from __future__ import annotations

import html
import re
import time

import pytest
from conftest import SMALL

from pingworks.llm import htmltext as H

SENTENCE = "It rained on the hill all night, and in the morning the road was gone. "


def _plain(page: str) -> str:
    """The article of a generated page by its tags alone."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    parts = re.split(r"<(?:/?p|/?h1|br)>", found[1] if found else "")
    texts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_query_against_the_articles_of_the_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = H.query(spark, SMALL).collect()
    assert len(rows) == len(pages) > 10
    for r in rows:
        assert r.text == _plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


P = [SENTENCE * k for k in (3, 1, 5, 2)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in P)
NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Contact us</a></li></ul>'
COMMENTS = '<div class="comments"><h3>Comments</h3><div class="comment"><p>I was there, and it was not so bad. Really!</p></div></div>'
BODY = "\n".join(x.strip() for x in P)

LAYOUTS = {
    "article": (f"<nav>{NAV}</nav><article><header><h1>Road lost</h1></header>{PARAGRAPHS}</article><aside>Read more, now.</aside><footer>All rights, 2024.</footer>", "Road lost\n" + BODY),
    "divs": (f'<div id="menu">{NAV}</div><div id="content"><h1>Road lost</h1>{PARAGRAPHS}</div><div id="footer">All rights reserved, 2024.</div>', "Road lost\n" + BODY),
    "divs without names": (f"<div>{NAV}</div><div><h1>Road lost</h1>{PARAGRAPHS}</div><div>{NAV}</div>", "Road lost\n" + BODY),
    "heading outside the body": (f'<div class="x"><h1>Road lost</h1><div class="y">{PARAGRAPHS}</div></div><div>{NAV}</div>', "Road lost\n" + BODY),
    "comments and adverts inside": (f'<article><h1>Road lost</h1><p>{P[0]}</p><div class="ad-box">Buy boots, cheap!</div><p>{P[2]}</p>{COMMENTS}</article>', f"Road lost\n{P[0].strip()}\n{P[2].strip()}"),
    "list in the article": (f"<main><h1>Road lost</h1>{PARAGRAPHS}<ul><li>rope</li><li>boots</li></ul><h2>Then</h2><p>{P[1]}</p></main>", f"Road lost\n{BODY}\nrope\nboots\nThen\n{P[1].strip()}"),
    "named wrapper": (f'<div class="page has-sidebar"><div class="sidebar">{NAV}<p>About me, and more.</p></div><div class="post"><h1>Road lost</h1>{PARAGRAPHS}</div></div>', "Road lost\n" + BODY),
    "table": (f"<table><tr><td>{NAV}</td><td><h1>Road lost</h1>{PARAGRAPHS}</td></tr></table>", "Road lost\n" + BODY),
    "cookie notice": (f'<div class="cookie-notice"><p>{SENTENCE}</p><button>OK, fine.</button></div><article>{PARAGRAPHS}</article><form><label>Name.</label></form>', BODY),
    "hidden": (f"<div hidden><p>{P[2]}</p></div><article>{PARAGRAPHS}</article>", BODY),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    body, want = LAYOUTS[name]
    assert H.main_text(f"<!DOCTYPE html><html><head><title>T.</title></head><body>{body}</body></html>") == want


def test_markup():
    page = lambda x: H.main_text(f"<article>{x}</article>")
    assert page("<p>a &amp; b&nbsp;&#233;&eacute;<b>c</b><i> d</i></p>") == "a & b ééc d"
    assert page("<p> one\n\t two <p>three<br>four") == "one two\nthree\nfour"
    assert page('<p title="a > b" data-x=\'<p>\'>text</p>') == "text"
    assert page('<p title="never closed>text</p><p>more') == "text\nmore"
    assert page("<p>a < b and 2<3</p><!-- <p>no</p> --><p>c") == "a < b and 2<3\nc"
    assert page('<script>var t = "<p>no</p>";</script><style>p{}</style><p>yes') == "yes"
    assert page("<p>yes<script>never closed <p>no") == "yes"
    assert page("</div></p>x</nothing>y") == "x\ny"
    assert page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert page("<P>UP</P><svg><text>no</text></svg><p>a<a href=x>b</a>c</p>") == "UP\nabc"
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>a</nav>") == ""
    assert H.main_text("just text, no tags") == "just text, no tags"


def test_blocks_and_paths():
    found, _ = H.blocks("<body><div><p>One, two. <a>three</a></p></div><nav><a>four</a></nav></body>")
    assert [(str(b.at.path), b.text, b.size, b.linked, b.marks) for b in found] == [("/body/div/p", "One, two. three", 10, 5, 2), ("/body/nav", "four", 0, 4, 0)]


@pytest.mark.parametrize(
    "piece",
    ["<p>word word, word.</p>", "<div>", '<a "', "<a '\"", "</p", "<!--", "<p><b>x<br>", "<li>a.", "<script>", "<h1>t</h1>", "&amp;&#x"],
)
def test_long_pages_take_time_by_their_length(piece):
    took = []
    for size in (300_000, 3_000_000):
        page = "<article>" + piece * (size // len(piece))
        start = time.perf_counter()
        H.main_text(page)
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * max(took[0], 0.05), took


def test_odd_rows(spark):
    rows = [(1, "u", "<p>Hello there.</p>", "x", 5), (1, "u", "<p>Hello there.</p>", "x", 5), (None, None, None, None, None), (2, "v", "", "y", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, H.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "Hello there.", 12)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert H.extract(df.limit(0)).count() == 0 and H.extract(df).columns == ["page_id", "url", "text", "n_chars"]
