"""Main text: known pages, unseen layouts, block rules, damaged pages."""

import re
from collections import Counter

import numpy as np
import pytest

from inkmirror.llm import layouts, main_text
from inkmirror.llm.trees import BoostedTrees
from tests_llm_texts import ENGLISH, prose

WORDS = prose(ENGLISH, 4000, 1).split()


@pytest.fixture(scope="module")
def extractor():
    return main_text.train(layouts.laid_out(WORDS, 400))


def one(extractor, html):
    return extractor.texts([html.encode()])[0]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>A &amp; B</h1><p>First   text with <b>bold</b>
and <a href="/x">a link</a> in it, long enough to be read as a text.<p>Second text &#8212; also long enough to count, and more of it.</p>
<div class="ad">Buy now</div><p>Third&nbsp;text closes the matter, with some words more.</p></article>
<section id="comments" class="comments"><h3>Replies</h3><ol><li><p>I do not agree with any of it.</p></li></ol></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; 2024 Someone</footer></body></html>"""


def test_known_page(extractor):
    assert one(extractor, PAGE) == (
        "A & B\nFirst text with bold and a link in it, long enough to be read as a text.\n"
        "Second text — also long enough to count, and more of it.\nThird text closes the matter, with some words more."
    )


def test_unseen_layouts(extractor):
    exact, agree = [], []
    for page in layouts.laid_out(WORDS, 150, seed=77):
        read = main_text.Page(page)
        truth = [0] * len(read.tags)
        for n in range(1, len(read.tags)):
            truth[n] = truth[read.parents[n]] if read.truth[n] is None else read.truth[n]
        want = [t for n, t in read.blocks if truth[n]]
        got = one(extractor, re.sub(r' data-main="[01]"', "", page)).split("\n")
        exact.append(got == want)
        agree.append(2 * sum((Counter(got) & Counter(want)).values()) / (len(got) + len(want)))
    assert np.mean(exact) > 0.85 and np.mean(agree) > 0.95


@pytest.mark.parametrize(
    "html",
    ["", " ", "plain", "<", "<p", "<p class='x", "<!-- never ends", "<script>x", "</div></p>", "<div>" * 3000 + "x", "<p a=\"" + "x" * 50_000,
     "<table><tr><td>a<td>b<tr><td>c</table>", "&#99999999; &bogus; &amp", "<svg><p>x</p></svg>", "<p>a</p>" * 4000],
)
def test_damaged_pages(extractor, html):
    assert "<p>" not in one(extractor, html)


def test_decoding_is_consistent():
    """A dropped subtree holds nothing kept, and the choice is the best of all consistent ones."""
    page = main_text.Page("<div><div>aaaa<p>bbbb</p><p>cccc</p></div><div>dddd</div></div>")
    text = page.kept([2.0] * len(page.tags), 1.0)
    assert text == "aaaa\nbbbb\ncccc\ndddd"
    assert page.kept([-2.0] * len(page.tags), 1.0) == ""
    signs = [0, 0, 3.0, 3.0, 3.0, -9.0]
    assert page.kept(signs, 0.5) == "aaaa\nbbbb\ncccc"


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = BoostedTrees(30, 3).fit(x[:3000], y[:3000])
    assert ((trees.logits(x[3000:]) > 0) == (y[3000:] > 0.5)).mean() > 0.97


def test_edge_rows(spark, extractor):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, "x"), (4, "u", "<p>" + "word " * 200_000, "x")],
        "page_id bigint, url string, html string, text string",
    )
    rows = {r["page_id"]: r for r in main_text.extract(pages, extractor).collect()}
    assert rows[1]["text"] == rows[2]["text"] == "" and rows[1]["n_chars"] == 0
    assert rows[None]["n_chars"] == len(rows[None]["text"]) > 100
    assert len(rows) == 4
    assert main_text.extract(pages.limit(0), extractor).count() == 0
    assert main_text.fit(pages.limit(0)).texts([b""]) == [""]


def blocks(html):
    return [text for _, text in main_text.Page(html).blocks]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>No</title><meta charset=x><body><p>a</p><p>b</p>", ["a", "b"]),
        ("<head><title>No</title><link rel=x><p>a</p>", ["a"]),
        ("<head><title>No</title></head><body><p>a</p>", ["a"]),
        *[(f"<div><p>a</p><div><{t}>no</div><p>b</p></div><p>c</p>", ["a", "b", "c"]) for t in ("button", "select", "object", "svg")],
        ("<div><object><div>no</div><p>no</p></object><p>a</p></div>", ["a"]),
        ("<div><svg><button>no</svg><p>a</p></div>", ["a"]),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", ["so x=2 holds"]),
    ],
)
def test_silent_elements_end(html, want):
    assert blocks(html) == want
