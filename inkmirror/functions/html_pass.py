"""One pass over a page's HTML: pick the main block, drop junk, write Markdown.

Spark has no HTML functions, so this small kernel runs inside Arrow batches.
Everything around it (routing, joins, counts, link rewriting) is column code.
The parser yields a flat token list; blocks, lists and emphasis are then written
in one sweep over a token range.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .text_basics import WS_CHARS

# Selectors, tag names, lengths.
MAIN_CONTENT_SELECTORS = (
    "article",
    "main",
    "#js_content",
    "[role='main']",
    ".article-content",
    ".post-content",
    ".entry-content",
    "#content",
    "#article",
)
JUNK_TAGS = frozenset("script style nav header footer aside iframe form noscript svg".split())
MARKDOWN_DROPPED_TAGS = frozenset("style script nav header footer noscript".split())
SUMMARY_META = "og:description"
MAIN_MIN_LENGTH = 200
BODY_MIN_LENGTH = 80
MAX_EQUAL_MARKS = 3
MARKERS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "a": "["}
JS_SPACE = WS_CHARS

VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html li main nav noscript ol p pre section table tbody td tfoot th thead tr ul".split()
)
INLINE_FORMAT = frozenset("a b big code em font i s small strike strong tt u".split())
# an opening tag ends these open elements, unless one of the borders lies between
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = BLOCK_TAGS - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}


class PageTokens(HTMLParser):
    """Tokens ``(kind, tag or text, attributes)`` with missing end tags filled in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, str, dict]] = []
        self.close_of: dict[int, int] = {}
        self._open: list[int] = []
        self._pending: list[int] = []  # emphasis that goes on in the next block
        self.feed(html)
        self.close()
        while self._open:
            self._shut(len(self._open) - 1)

    def _tag(self, slot: int) -> str:
        return self.tokens[self._open[slot]][1]

    def _shut(self, slot: int) -> int:
        start = self._open.pop(slot)
        self.close_of[start] = len(self.tokens)
        self.tokens.append(("shut", self.tokens[start][1], {}))
        return start

    def _shut_through(self, slot: int) -> None:
        while len(self._open) > slot:
            start = self._shut(len(self._open) - 1)
            if len(self._open) > slot and self.tokens[start][1] in INLINE_FORMAT:
                # of equal open marks at most three go on, as in browsers
                if sum(self.tokens[p][1:] == self.tokens[start][1:] for p in self._pending) < MAX_EQUAL_MARKS:
                    self._pending.insert(0, start)

    def _end_open(self, tags: set, borders: set) -> None:
        for slot in range(len(self._open) - 1, -1, -1):
            if self._tag(slot) in tags:
                self._shut_through(slot)
                return
            if self._tag(slot) in borders:
                return

    def _resume(self) -> None:
        pending, self._pending = self._pending, []
        for start in pending:
            self._push(*self.tokens[start][1:])

    def _push(self, tag: str, attrs: dict) -> None:
        self._open.append(len(self.tokens))
        self.tokens.append(("open", tag, attrs))

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ENDS_PARAGRAPH:
            self._end_open({"p"}, {"table", "td", "th", "button"})
        if tag in ENDED_BY:
            self._end_open(*ENDED_BY[tag])
        if tag not in BLOCK_TAGS:
            self._resume()
        if tag in VOID_TAGS:
            self.close_of[len(self.tokens)] = len(self.tokens)
            self.tokens.append(("open", tag, attrs))
        else:
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for slot in range(len(self._open) - 1, -1, -1):
            if self._tag(slot) == tag:
                if tag in INLINE_FORMAT and any(self._tag(s) in BLOCK_TAGS for s in range(slot + 1, len(self._open))):
                    self._shut(slot)
                else:
                    self._shut_through(slot)
                return
            if tag not in BLOCK_TAGS and tag not in INLINE_FORMAT and self._tag(slot) in BLOCK_TAGS:
                break
        for at, start in reversed(list(enumerate(self._pending))):
            if self.tokens[start][1] == tag:
                del self._pending[at]
                return

    def handle_data(self, data):
        if self._pending and data.strip():
            self._resume()
        self.tokens.append(("text", data, {}))

    # ---- reading ranges ----

    def first(self, matches) -> int | None:
        return next((i for i, (kind, tag, attrs) in enumerate(self.tokens) if kind == "open" and matches(tag, attrs)), None)

    def text(self, start: int, stop: int, dropped=frozenset()) -> str:
        parts, i = [], start
        while i < stop:
            kind, value, _ = self.tokens[i]
            if kind == "open" and value in dropped:
                i = self.close_of[i]
            elif kind == "text":
                parts.append(value)
            i += 1
        return "".join(parts)


def _matcher(selector: str):
    if selector[0] == "#":
        return lambda tag, attrs: attrs.get("id") == selector[1:]
    if selector[0] == ".":
        return lambda tag, attrs: selector[1:] in attrs.get("class", "").split()
    if selector[0] == "[":
        name, value = selector[1:-1].split("=")
        return lambda tag, attrs: attrs.get(name) == value.strip("'")
    return lambda tag, attrs: tag == selector


def utf16_len(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def main_block(page: PageTokens) -> tuple[str, int, int]:
    """Name, first and last token of the main content."""
    for selector in MAIN_CONTENT_SELECTORS:
        start = page.first(_matcher(selector))
        if start is not None and utf16_len(page.text(start, page.close_of[start]).strip(JS_SPACE)) > MAIN_MIN_LENGTH:
            return selector, start, page.close_of[start]
    before = [0]  # text length up to each token
    for kind, value, _ in page.tokens:
        before.append(before[-1] + (utf16_len(value) if kind == "text" else 0))
    best, best_length = None, 0
    for i, (kind, tag, _) in enumerate(page.tokens):
        if kind == "open" and tag == "div" and before[page.close_of[i]] - before[i] > best_length:
            best, best_length = i, before[page.close_of[i]] - before[i]
    if best is not None:
        return "div", best, page.close_of[best]
    body = page.first(lambda tag, attrs: tag == "body")
    if body is not None:
        return "body", body, page.close_of[body]
    head = page.first(lambda tag, attrs: tag == "head")
    return "body", 0 if head is None else page.close_of[head] + 1, len(page.tokens)


# ---- Markdown ---------------------------------------------------------------

# By the CommonMark specification a backslash keeps a character from opening inline markup
# anywhere, and at the start of a line what would open a block: a list, a quote, a heading (also by
# a line of signs below it), a fence.
INLINE_MARKUP = re.compile(r"[\\`*_\[\]]")
BLOCK_OPENER = re.compile(r"[->=]|~~~|\+(?= )|#{1,6}(?= )|(?P<number>\d+)(?=\. )")


def _escaped(text: str) -> str:
    text = INLINE_MARKUP.sub(lambda mark: "\\" + mark[0], text)
    opener = BLOCK_OPENER.match(text)
    if opener is None:
        return text
    # the point of a list number is escaped, else the first character
    at = opener.end() if opener["number"] else 0
    return text[:at] + "\\" + text[at:]


def _wrapped(tag: str, attrs: dict, inner: str) -> str:
    if tag == "a":
        title = f' "{attrs["title"]}"' if attrs.get("title") else ""
        return f"[{inner}]({attrs['href']}{title})" if "href" in attrs else inner
    if tag == "code":
        fence = "`" * (max(map(len, re.findall("`+", inner)), default=0) + 1)
        pad = " " if inner[0] == "`" or inner[-1] == "`" else ""
        return fence + pad + inner + pad + fence
    return MARKERS[tag] + inner + MARKERS[tag]


def _inline(runs: list[tuple[str, tuple]], attrs_of) -> str:
    """Text runs with their open marks as one line of Markdown."""
    out: list[str] = []
    opened: list[tuple[int, int]] = []  # mark, place in out
    for text, marks in [*runs, ("", ())]:
        same = 0
        while same < min(len(opened), len(marks)) and opened[same][0] == marks[same]:
            same += 1
        while len(opened) > same:
            mark, place = opened.pop()
            inner = "".join(out[place:])
            del out[place:]
            core = inner.strip()
            if core:  # blanks at the edges stay outside the markers
                lead, tail = inner[: inner.index(core)], inner[inner.index(core) + len(core) :]
                inner = lead + _wrapped(*attrs_of(mark), core) + tail
            out.append(inner)
        for mark in marks[same:]:
            opened.append((mark, len(out)))
        out.append(text)
    return "".join(out)


class _Writer:
    def __init__(self, page: PageTokens):
        self.page = page
        self.runs: list[tuple[str, tuple]] = []
        self.marks: list[int] = []
        self.heading = 0
        self.nest: list[tuple[str, dict, list[tuple[str, str]]]] = [("root", {}, [])]

    def block(self, text: str, kind: str = "block") -> None:
        self.nest[-1][2].append((kind, text))

    def add(self, text: str, collapse: bool = True) -> None:
        if collapse:
            text = re.sub(r"[ \t\r\n]+", " ", text)
            if not self.runs or self.runs[-1][0].endswith((" ", "\n")):
                text = text.lstrip(" ")
        if text:
            self.runs.append((text, tuple(self.marks)))

    def flush(self) -> None:
        text = _inline(self.runs, lambda mark: self.page.tokens[mark][1:]).strip(" \n")
        self.runs = []
        if text:
            self.block("#" * self.heading + " " + re.sub(r"\s*\n\s*", " ", text) if self.heading else text)

    def joined(self, blocks: list[tuple[str, str]]) -> str:
        out = ""
        for kind, text in blocks:
            inside_item = kind == "list" and self.nest[-1][0] in ("ul", "ol")
            out += ("" if not out else "\n" if inside_item else "\n\n") + text
        return out

    def leave(self, tag: str) -> None:
        if not any(entry[0] == tag for entry in self.nest[1:]):
            return
        while True:
            name, attrs, blocks = self.nest.pop()
            if name == "li":
                number = None
                if self.nest[-1][0] == "ol":
                    start = self.nest[-1][1].get("start", "1")
                    number = (int(start) if start.isdigit() else 1) + len(self.nest[-1][2])
                text = self.joined(blocks)
                mark = "-   " if number is None else f"{number}.  "
                self.block(mark + text.replace("\n", "\n    "), "item")
            elif name == "blockquote":
                self.block("\n".join(("> " + line).rstrip() for line in self.joined(blocks).split("\n")))
            elif blocks:
                self.block("\n".join(text for _, text in blocks), "list")
            if name == tag:
                return

    def write(self, start: int, stop: int, dropped: frozenset) -> str:
        page, i = self.page, start
        while i < stop:
            kind, tag, attrs = page.tokens[i]
            if kind == "text":
                in_code = any(page.tokens[m][1] == "code" for m in self.marks)
                self.add(tag if in_code else _escaped(re.sub(r"[ \t\r\n]+", " ", tag)))
            elif kind == "open" and tag in dropped:
                i = page.close_of[i]
            elif kind == "open" and tag == "pre":
                self.flush()
                self.fenced(i)
                i = page.close_of[i]
            elif kind == "open":
                self.enter(i, tag, attrs)
            elif tag in MARKERS:
                self.marks = [m for m in self.marks if page.close_of[m] != i]
            elif tag in BLOCK_TAGS:
                self.flush()
                self.heading = 0
                if tag in ("ul", "ol", "li", "blockquote"):
                    self.leave(tag)
            i += 1
        self.flush()
        while len(self.nest) > 1:
            self.leave(self.nest[-1][0])
        return self.joined(self.nest[0][2])

    def enter(self, i: int, tag: str, attrs: dict) -> None:
        if tag == "br":
            self.runs.append(("  \n", tuple(self.marks)))
        elif tag == "img":
            source = attrs.get("src", "")
            if source:
                title = f' "{attrs["title"]}"' if attrs.get("title") else ""
                self.add(f"![{re.sub(chr(10) + '+', chr(10), attrs.get('alt', ''))}]({source}{title})", collapse=False)
        elif tag in MARKERS:
            self.marks.append(i)
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "hr":
                self.block("* * *")
            elif tag in ("ul", "ol", "li", "blockquote"):
                self.nest.append((tag, attrs, []))
            elif re.fullmatch("h[1-6]", tag):
                self.heading = int(tag[1])

    def fenced(self, i: int) -> None:
        inner = self.page.tokens[i + 1 : self.page.close_of[i]]
        text = "".join(value for kind, value, _ in inner if kind == "text")
        code = next((attrs for kind, value, attrs in inner if kind == "open" and value == "code"), None)
        if code is None:
            self.block(text.strip("\n"))
            return
        language = re.search(r"language-(\S+)", code.get("class", ""))
        fence = "`" * max(3, max(map(len, re.findall("^`{3,}", text, re.M)), default=2) + 1)
        self.block(f"{fence}{language.group(1) if language else ''}\n{text.removesuffix(chr(10))}\n{fence}")


def html_to_markdown(html: str) -> str:
    page = PageTokens(html)
    return _Writer(page).write(0, len(page.tokens), MARKDOWN_DROPPED_TAGS)


def article(html: str) -> tuple:
    """selector, length of the block, length without junk, Markdown."""
    page = PageTokens(html)
    selector, start, stop = main_block(page)
    length = utf16_len(page.text(start, stop).strip(JS_SPACE))
    clean = utf16_len(page.text(start, stop, JUNK_TAGS).strip(JS_SPACE))
    enough = clean >= BODY_MIN_LENGTH
    return selector, length, clean, _Writer(page).write(start, stop, JUNK_TAGS) if enough else None


# ---- Arrow batches ------------------------------------------------------------

# the kernel travels with the plan, so executors need no installed copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _guarded(function, value, width: int) -> tuple:
    """Results of one row and its error; a broken page must not end the job."""
    if value is None:
        return (None,) * (width + 1)
    try:
        result = function(value)
        return (*(result if isinstance(result, tuple) else (result,)), None)
    except Exception as error:  # any failure of this page is a result of this row
        return (*(None,) * width, f"{type(error).__name__}: {error}")


MARKDOWN_RESULT = StructType([StructField(name, StringType()) for name in ("markdown", "error")])
ARTICLE_RESULT = StructType(
    [
        StructField("selector", StringType()),
        StructField("block_length", IntegerType()),
        StructField("clean_length", IntegerType()),
        StructField("markdown", StringType()),
        StructField("error", StringType()),
    ]
)


@F.pandas_udf(MARKDOWN_RESULT)
def markdown_pass(html: pd.Series) -> pd.DataFrame:
    rows = [_guarded(html_to_markdown, value, 1) for value in html]
    return pd.DataFrame(rows, columns=MARKDOWN_RESULT.names, dtype=object)


@F.pandas_udf(ARTICLE_RESULT)
def article_pass(html: pd.Series) -> pd.DataFrame:
    rows = [_guarded(article, value, 4) for value in html]
    return pd.DataFrame(rows, columns=ARTICLE_RESULT.names, dtype=object)
