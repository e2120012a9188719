"""The HTML kernel and the jobs around it, by properties and literal pages."""

import random

import pytest
from pyspark.sql import functions as F

from inkmirror.functions import html_pass as hp
from inkmirror.functions import urls
from inkmirror.operators import bodies, images

LONG = "word " * 60


@pytest.mark.parametrize(
    "source,want",
    [
        ("<h1>T &amp; x</h1><h3>y</h3>", "# T & x\n\n### y"),
        ("<p>a <b> bold </b>c <i></i><em>e</em></p>", "a **bold** c *e*"),
        ("<p>a<br>b</p>", "a  \nb"),
        ('<a href="u" title="t">l<i>x</i></a> <a>plain</a>', '[l*x*](u "t") plain'),
        ("<ul><li>one<ul><li>in</li></ul></li><li>two</ul>", "-   one\n    -   in\n-   two"),
        ("<ol start=3><li>x<li>y</ol>", "3.  x\n4.  y"),
        ('<pre><code class="language-py">a\n  b_c\n</code></pre>', "```py\na\n  b_c\n```"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
        ("<p><b>z<p>w</b>q", "**z**\n\n**w**q"),
        ("<p><b>1<p><b>2<p><b>3<p><b>4<p>5", "**1**\n\n****2****\n\n******3******\n\n********4********\n\n******5******"),
        ("a<hr>b", "a\n\n* * *\n\nb"),
        ('<img src="s" alt="k"><img>', "![k](s)"),
        ('<img data-src="lazy" src="wait">', "![](wait)"),
        ("<script>x</script><style>y</style><nav>n</nav><header>h</header><footer>f</footer><noscript>o</noscript>k", "k"),
        ("1. x_y *z* [l] `c`", "1\\. x\\_y \\*z\\* \\[l\\] \\`c\\`"),
        ("<code>a*b_</code> <code>`t`</code>", "`a*b_` `` `t` ``"),
        ("<table><tr><td>a<td>b</table>", "a\n\nb"),
        ("  lots \n of\t space  ", "lots of space"),
        ("", ""),
        ("<p></p><div><span> </span></div>", ""),
        ("a</p></div></b>b", "ab"),
    ],
)
def test_markdown(source, want):
    assert hp.html_to_markdown(source) == want


def test_markdown_never_breaks_on_damaged_pages():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<blockquote>", "</blockquote>", "<h2>", "</h2>", "<a href=x>",
             "</a>", "text ", "&amp;", "<br>", "<table><tr><td>", "</table>", "<!-- c -->", "<pre><code>", "</code></pre>", "<", "</", "<img src=i>"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        out = hp.html_to_markdown(page)
        assert "<p>" not in out and "<li>" not in out
        assert hp.article(page)[0] in ("div", "body")


def test_deep_nesting_needs_no_recursion():
    assert hp.html_to_markdown("<div>" * 5000 + "x" + "</div>" * 5000) == "x"


@pytest.mark.parametrize(
    "page,selector",
    [
        (f"<body><article>{LONG}</article>", "article"),
        (f"<article>short</article><main>{LONG}</main>", "main"),
        (f'<div id="js_content">{LONG}</div>', "#js_content"),
        (f'<section role="main">{LONG}</section>', "[role='main']"),
        (f'<span class="a post-content b">{LONG}</span>', ".post-content"),
        (f'<div class="article-content">{LONG}</div><div id="content">{LONG}</div>', ".article-content"),
        (f'<p class="entry-content">{LONG}</p>', ".entry-content"),
        (f'<i id="article">{LONG}</i>', "#article"),
        (f"<article>a</article><article>{LONG}</article><div>d</div>", "div"),  # only the first match of a selector counts
        ("<div>aa</div><div>bbb</div><div>ccc</div>", "div"),
        ("<p>text</p>", "body"),
        ("", "body"),
        (f"<article><script>{LONG}</script></article>", "article"),  # junk counts while choosing
    ],
)
def test_main_block(page, selector):
    assert hp.main_block(hp.PageTokens(page))[0] == selector


def test_longest_div_wins_and_the_first_of_equals():
    page = hp.PageTokens("<div>aa</div><div>bbb</div><div>ccc</div>")
    _, start, stop = hp.main_block(page)
    assert page.text(start, stop) == "bbb"


def test_article_jobs(spark):
    junk = "<aside>ASIDE</aside><form>FORM</form><svg>SVG</svg><iframe>IFRAME</iframe>"
    pages = [
        ("good", f'<article>{junk}<h2>H</h2><p>{LONG}</p><img data-src="/i.png"></article>'),
        ("summary", '<head><meta property="og:description" content=" sum "></head><div>tiny</div>'),
        ("named", '<meta name="og:description" content="other"><div>tiny</div>'),
        ("plain", "<div>tiny</div>"),
        ("junk only", f"<article><script>{LONG}</script></article>"),
        ("entity", f"<article><p>{LONG}&amp;#x110000;</p></article>"),
    ]
    frame = spark.createDataFrame([(t, "https://h.com/a/", h) for t, h in pages], "title STRING, url STRING, text STRING")
    got = {r["title"]: r for r in bodies.extract_articles(frame).collect()}
    head = "# {}\n\n[原文链接](https://h.com/a/)\n\n"
    assert got["good"]["body"] == head.format("good") + f"## H\n\n{LONG.strip()}\n\n![](https://h.com/i.png)"
    assert got["summary"]["body"] == head.format("summary") + "> sum"
    assert got["named"]["body"] == head.format("named") + "> other"
    for title in ("plain", "junk only", "entity"):
        assert got[title]["body"] == head.format(title) + "> 正文抓取失败，仅保留链接。"
    assert {t: r["degraded"] for t, r in got.items()} == {t: t != "good" for t, _ in pages}
    assert (got["junk only"]["block_length"], got["junk only"]["clean_length"]) == (len(LONG.strip()), 0)


def test_body_conversion(spark):
    rows = [
        ("blank", " \n"), ("null", None), ("html", "<p>a &amp; <b>b</b></p>"), ("markdown", "a &lt; b<br>c\n\n\n\nd"),
        ("hidden", "a &lt;div&gt;b"), ("broken", "x &#x110000;"), ("broken html", "<p>x &amp;#x110000;</p>"), ("plain", "x"),
    ]
    frame = spark.createDataFrame(rows, "k STRING, raw STRING")
    got = {r["k"]: (r["body"], r["body_error"]) for r in bodies.convert_bodies(frame, "raw").collect()}
    assert got == {
        "blank": ("", None), "null": ("", None), "html": ("a & **b**", None), "markdown": ("a < b\nc\n\nd", None),
        "hidden": ("a\n\nb", None), "broken": (None, bodies.BAD_ENTITY), "broken html": ("<p>x &#x110000;</p>", None), "plain": ("x", None),
    }


def test_plain_texts_take_no_detour(spark):
    """Only HTML rows carry a text to the converter."""
    rows = spark.createDataFrame([("a",), ("<p>b",)], "raw STRING")
    plan = bodies.convert_bodies(rows, "raw")._jdf.queryExecution().toString()
    assert plan.count("ArrowEvalPython") >= 1 and "BatchEvalPython" not in plan


def test_stored_files(spark):
    items = spark.createDataFrame(
        [(1, "p", "n", "T", "http://h/x.PDF", "", "one"), (2, "p", "n", "T", "http://h/y.pdf", "", "two"), (3, "p", "m", "U", "u", "text/markdown", "md")],
        "seq BIGINT, parent STRING, name STRING, title STRING, url STRING, content_type STRING, bytes STRING",
    )
    stored = bodies.stored_originals(items)
    assert {r["file_path"] for r in stored.collect()} == {"p/n.pdf", "p/m.md"}
    old = spark.createDataFrame([("p/n.pdf", "old"), ("p/z.pdf", "kept")], "path STRING, body STRING")
    after = bodies.overwrite_files(old, stored.select("file_path", "seq", F.col("bytes").alias("body")))
    assert {r["path"]: r["body"] for r in after.collect()} == {"p/n.pdf": "two", "p/z.pdf": "kept", "p/m.md": "md"}


def test_image_regex_sees_only_images(spark):
    frame = spark.createDataFrame([("![a](b)",), ("<img src='b'>",), ('<IMG  src="b">',), ("!(b)",), (None,)], "s STRING")
    got = [r[0] for r in frame.select(F.col("s").rlike(images.HAS_IMAGE)).collect()]
    assert got == [True, False, True, False, None]


def test_notes_read_src_and_articles_data_src(spark):
    image = '<img data-src="a.png" src="b.png">'
    assert hp.html_to_markdown(f"<p>{image}</p>") == "![](b.png)"
    page = f"<article><p>{'word ' * 60}</p>{image}</article>"
    frame = spark.createDataFrame([("t", "http://h/p", page)], "title STRING, url STRING, text STRING")
    assert "![](http://h/a.png)" in bodies.extract_articles(frame).first()["body"]


def test_addresses_and_tags_are_column_code(evaluate):
    cases = [
        ("../q.gif?v=1", "https://H.com/a/b/c", "https://h.com/a/q.gif?v=1"),
        ("//cdn/s.png", "http://h.com", "http://cdn/s.png"),
        ("?k=v", "http://h.com/a?x=1#f", "http://h.com/a?k=v"),
        ("ä b.png?ö", "http://h.com", "http://h.com/%C3%A4%20b.png?%C3%B6"),
        ("HTTPS://O.org/P/../q", "http://h.com", "https://o.org/q"),
        ("a/./b/..", "http://h.com/x/", "http://h.com/x/a/"),
        ("x.png", "no address", None),
    ]
    got = evaluate(urls.absolute_url("r", "b"), "r STRING, b STRING", [c[:2] for c in cases])
    assert got == [c[2] for c in cases]
    tags = ['<img data-src="a" src="b">', "<IMG src=w data-src='l'/>", '<img data-src="" src="k">', '<img src="only">', None]
    assert evaluate(urls.promote_lazy_images("h"), "h STRING", tags) == [
        '<img src="a" >', "<IMG  src='l'/>", '<img data-src="" src="k">', '<img src="only">', None,
    ]
