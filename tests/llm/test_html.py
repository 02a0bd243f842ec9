import time

import numpy as np
import pytest

from octoplex.llm import html

BODY = "<h1>Title</h1><p>First words of it</p><p>More words of it</p>"
TEXT = "Title\n\nFirst words of it\n\nMore words of it"
LONG = "words of a paragraph that goes on for a while, " * 6

MALFORMED = (
    f"<html><head><title>x</title><article>{BODY}</article>",
    f"<head><title>no end<body><article>{BODY}</article>",
    f"<html><head><meta charset=utf-8><body class='page has-sidebar nav-open'><article>{BODY}</article>",
    f"<article>{BODY}",
    f"<nav><a href=/>Home</a></nav><article>{BODY}</article></article></div></p>",
    "<article><h1>Title</h1><p>First words of it<p>More words of it",
    "<article><h1>Title<p>First words of it</p><p>More words of it</p></article>",
    f"<article><button>Go{BODY}</article>",
    f"<article><select><option>one<option>two{BODY}</article>",
    f"<article><p title=\"x></p>{BODY}</article>",
    f"<article><p title='x></p>{BODY}</article>",
    f"<article><p title=x\">{BODY}</article>",
    f"<article><!-- {BODY} -->{BODY}</article>",
    f"<article><!-->{BODY}</article>",
    f"<article><!x {1}><?php y ?>{BODY}</article>",
    f"<article></ x>{BODY}</article>",
    f"<article>{BODY}<script>if (a<b) '</p>'</article></script>",
    f"<article>{BODY}<style>p{{}}",
    f"<article>{BODY}<textarea><p>typed</p>",
    f"<article>{BODY}<noscript>off</noscript><iframe src=x>frame</iframe></article>",
    f"<article>{BODY}<svg><title>picture</title><text>drawn</text></svg></article>",
    f"<article>{BODY}<template>{'<div>' * 9}never{'</div>' * 9}</template></article>",
    f"<article>{BODY}<object>{'<div>' * 20}never</object></article>",
    f"<article>{BODY}<span hidden>a<span>b</span>c</span></article>",
    f"<article>{BODY}<div style='display : none'>gone</div></article>",
    f"<table><tr><td><article>{BODY}</td></div></table>",
    "<article><h1>Title</h1><p>First<b> words</p></b> <p>of it</p>".replace("</p></b> <p>", " ") + "<p>More words of it</article>",
    "<article><h1>Title</h1><ul><li>First words of it<li>More words of it</ul></article>",
    "<article><h1>Title</h1><dl><dt>First words of it<dd>More words of it</dl></article>",
    "<article><h1>Title</h1><table><tr><td>First words of it<td>More words of it</table></article>",
    f"<ARTICLE CLASS=POST>{BODY.upper().replace('TITLE', 'Title').replace('FIRST WORDS OF IT', 'First words of it').replace('MORE WORDS OF IT', 'More words of it')}</ARTICLE>",
    f"<form id=aspnet><article>{BODY}</article></form>",
    f"<article><h1>Title</h1><p>First words of it</p><p>More words of it<a href='/x",
    f"<article>{BODY}</article><b",
)


@pytest.mark.parametrize("page", MALFORMED)
def test_malformed_pages(page):
    assert html.main_text(page) == TEXT


def test_odd_texts():
    assert html.main_text("<article><p>a < b <3 &lt;p&gt; &amp;amp; &#x41;&nbsp;c<br/>d</p></article>") == "a < b <3 <p> &amp; A c d"
    assert html.main_text("<article><p class=notice-board>Kept</p><p class=notice>Gone</p><p class=shareholders>Kept too</p></article>") == "Kept\n\nKept too"
    assert html.main_text("<article><div class=header><h1>Head</h1></div><header><p>By</p></header><p>Body</p></article>") == "Head\n\nBy\n\nBody"


def test_pages_without_telling_tags():
    menu = "<ul><li><a href=/>Home</a><li><a href=/b>All news</a><li><a href=/c>About</a></ul>"
    links = "<p><a href=/x>Another story of some kind</a><p><a href=/y>One more story to read</a>"
    body = f"<div>{LONG}</div><div>Short words between</div><div>{LONG}</div>"
    got = html.main_text(f"{menu}<h2>A heading of a few words</h2>{body}{links}<p>Copyright 2020 X. All rights reserved.")
    assert got == f"A heading of a few words\n\n{LONG.strip()}\n\nShort words between\n\n{LONG.strip()}"
    assert html.main_text(menu) == ""


def test_the_tree_reads_neighbours():
    used = set(html.default_tree().features())
    assert len(used & {"words_before", "links_before", "words_after", "links_after"}) >= 2 and used & {"words", "links"}
    x, y = html.labelled()
    assert len(y) > 500 and (html.default_tree().predict(x) == (y > 0.5)).mean() > 0.98
    own = np.repeat(np.arange(len(rows := html.LABELLED.strip().splitlines())), [len(r.split()) for r in rows])
    right = sum((html.Tree(x[own % 10 != k], y[own % 10 != k]).predict(x[own % 10 == k]) == (y[own % 10 == k] > 0.5)).sum() for k in range(10))
    assert right > 0.95 * len(y)


@pytest.mark.parametrize("piece", ["<b x", '<a "', "<div></p>", "<table><td></table", "<li>", "<p title=\"x>a</p>", "<svg><title>", "<a href='", "<script", "<span hidden><li>", "<button>a", "<ul><li><p>"])
def test_time_grows_with_the_page(piece):
    began = time.time()
    html.main_text(piece * 20_000)
    assert time.time() - began < 5


def test_extract_edges(spark):
    rows = [(1, None, "a", None), (2, "", "a", 5), (2, "", "a", 5), (None, f"<article>{BODY}</article>", None, 1), (4, f"<article><p>{'long word ' * 300_000}</p></article>", "t", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string, words int")
    got = sorted(html.extract(pages).collect(), key=lambda r: r["page_id"] or 0)
    assert [(r["page_id"], r["words"]) for r in got] == [(None, 1), (1, None), (2, 5), (2, 5), (4, 2)] and got[0]["text"] == TEXT
    assert [r["text"] for r in got[1:4]] == [""] * 3 and len(got[4]["text"]) == 2_999_999
    assert html.extract(pages.where("page_id < 0")).count() == 0
