"""Main text of web pages by gradient-boosted trees over the nodes of the page.

A page becomes a tree of its block elements. Boosted trees score each node by tag,
attribute tokens (its own and its ancestors'), depth, text and link density of the
subtree, and how it stands among its siblings. Decoding is hierarchical: a node's subtree
is kept whole, dropped whole, or split at a cost and decided child by child, whichever
sums up best, so no kept node has a dropped ancestor or descendants that contradict it.

The training pages are laid out from words of a bounded sample of the pages, in many
layouts whose parts are known.

Defined results: a null or empty page has an empty text; a page without main text too;
repeated rows get equal results; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import in_slices
from .trees import BoostedTrees

# Bound of the training material: pages that lend words, their characters, pages laid out.
SAMPLE_PAGES, SAMPLE_CHARACTERS, LAYOUTS = 100, 20_000, 500

# Elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())  # their text is no markup
SILENT = frozenset("head template svg select button object audio video canvas datalist".split())
# What may stand in a head; any other tag ends one that is left open.
HEAD = RAW | frozenset("head base link meta template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element that begins closes these if they are open: within the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
TAG_GROUPS = [
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"div", "section", "center"},
    {"article", "main"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"dialog", "details", "summary"},
]
GROUP = {tag: i for i, tags in enumerate(TAG_GROUPS) for tag in tags}
APART = frozenset("nav footer aside form dialog".split())
ESSENCE = frozenset("article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TRUTH = re.compile(r'data-main="([01])"')
_WORD = re.compile(r"[a-z]+")


class Page:
    """Block elements in order of appearance, and the text blocks they hold."""

    __slots__ = ("tags", "parents", "tokens", "truth", "blocks", "links", "inline")

    def __init__(self, html: str):
        self.tags, self.parents, self.tokens, self.truth = ["#page"], [-1], [()], [None]
        self.blocks: list[tuple[int, str]] = []  # element, text
        self.links: list[int] = []  # characters of each block that stand in links
        self.inline = [0]  # inline tags of each element
        self._read(html)

    def _read(self, html: str) -> None:
        open_, held, linked, in_link = [0], [], 0, False
        silent: list[str] = []  # open silent elements
        inner: list[str] = []  # blocks open inside of them
        at, low = 0, None

        def flush() -> None:
            nonlocal linked
            if held:
                text = "".join(held)
                if "&" in text:
                    text = entities.unescape(text)
                text = " ".join(text.split())
                if text:
                    self.blocks.append((open_[-1], text))
                    self.links.append(min(linked, len(text)))
                held.clear()
            linked = 0

        for found in _TOKEN.finditer(html):
            begin = found.start()
            if begin < at:
                continue
            if begin > at and not silent:
                held.append(html[at:begin])
                if in_link:
                    linked += begin - at
            at = found.end()
            end, start, attributes = found.groups()
            if start:
                tag = start.lower()
                if silent == ["head"] and tag not in HEAD:
                    silent.clear()
                if tag in RAW:
                    low = low or html.lower()
                    close = low.find("</" + tag, at)
                    at = len(html) if close < 0 else close
                elif tag in SILENT:
                    if not attributes.endswith("/"):
                        if not silent:
                            flush()
                        silent.append(tag)
                elif tag in BLOCKS:
                    if silent:
                        if tag not in VOID:
                            inner.append(tag)
                    else:
                        flush()
                        in_link = False
                        if self.tags[open_[-1]] == "p":
                            open_.pop()
                        if tag in CLOSES:
                            ends, within = CLOSES[tag]
                            for depth in range(len(open_) - 1, 0, -1):
                                name = self.tags[open_[depth]]
                                if name in ends:
                                    del open_[depth:]
                                    break
                                if name in within:
                                    break
                        if tag not in VOID:
                            self._add(tag, open_, attributes)
                elif not silent:
                    self.inline[open_[-1]] += 1
                    if tag == "a":
                        in_link = True
                    elif tag in VOID:
                        held.append(" ")
            elif end:
                tag = end.lower()
                if tag in SILENT:
                    if tag in silent:
                        del silent[len(silent) - 1 - silent[::-1].index(tag) :]
                    if not silent:
                        inner.clear()
                elif tag in BLOCKS:
                    if silent and tag in inner:
                        del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                    elif silent and any(self.tags[i] == tag for i in open_[1:]):
                        # a block around the silent elements closes
                        silent.clear()
                        inner.clear()
                    if not silent:
                        for depth in range(len(open_) - 1, 0, -1):
                            if self.tags[open_[depth]] == tag:
                                flush()
                                del open_[depth:]
                                break
                elif tag == "a":
                    in_link = False
        if at < len(html) and not silent:
            rest = html[at:]
            cut = rest.rfind("<")  # a tag that never ends is no text
            held.append(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest[:cut])
        flush()

    def _add(self, tag: str, open_: list[int], attributes: str) -> None:
        self.parents.append(open_[-1])
        open_.append(len(self.tags))
        self.tags.append(tag)
        self.inline.append(0)
        if attributes:
            values = " ".join(_ATTRIBUTE.findall(attributes)).lower()
            self.tokens.append(tuple(_WORD.findall(values)) if values else ())
            truth = _TRUTH.search(attributes)
            self.truth.append(int(truth[1]) if truth else None)
        else:
            self.tokens.append(())
            self.truth.append(None)

    def features(self, odds: dict[str, float]) -> list[list[float]]:
        n = len(self.tags)
        own, total, link, points, tags = [0] * n, [0] * n, [0] * n, [0] * n, [1 + i for i in self.inline]
        mark, before, seen = [0] * n, [0] * n, 0
        first = [None] * n
        for (node, text), linked in zip(self.blocks, self.links):
            size = len(text)
            own[node] += size
            total[node] += size
            link[node] += linked
            points[node] += text.count(".") + text.count(",")
            if "©" in text:
                mark[node] = 1
            if first[node] is None:
                first[node] = seen
            seen += size
        children = [0] * n
        index = [0] * n
        for node in range(1, n):
            parent = self.parents[node]
            index[node] = children[parent]
            children[parent] += 1
        same = Counter(zip(self.parents, self.tags))
        for node in range(n - 1, 0, -1):
            parent = self.parents[node]
            total[parent] += total[node]
            link[parent] += link[node]
            points[parent] += points[node]
            tags[parent] += tags[node]
            if first[node] is not None and (first[parent] is None or first[node] < first[parent]):
                first[parent] = first[node]
        rows = []
        depth, low, high, apart, essence, worth = [0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0.0] * n
        whole = max(seen, 1)
        for node in range(n):
            parent, tag = self.parents[node], self.tags[node]
            worth[node] = sum(odds.get(t, 0.0) for t in self.tokens[node])
            up = max(parent, 0)
            if node:
                depth[node] = depth[up] + 1
                low[node], high[node] = min(low[up], worth[node]), max(high[up], worth[node])
                apart[node] = apart[up] or tag in APART
                essence[node] = essence[up] or tag in ESSENCE
            siblings = max(children[up], 1)
            group = [0.0] * len(TAG_GROUPS)
            if tag in GROUP:
                group[GROUP[tag]] = 1.0
            size = max(total[node], 1)
            start = first[node] or 0
            rows.append(
                [
                    depth[node], log1p(total[node]), link[node] / size, total[node] / tags[node], points[node] / size, log1p(own[node]),
                    siblings, index[node] / siblings, same[parent, tag] / siblings, log1p(total[up] / siblings), log1p(total[up]),
                    start / whole, (start + total[node]) / whole, total[node] / whole, worth[node], low[node], high[node],
                    float(apart[node]), float(essence[node]), float(mark[node]), *group,
                ]
            )
        return rows

    def kept(self, logit: list[float], split_cost: float) -> str:
        """The blocks of the subtrees that decoding keeps."""
        n = len(self.tags)
        size = [0] * n
        for node, text in self.blocks:
            size[node] += len(text)
        # an element without text of its own says little
        own = [v * (0.3 + log1p(s)) if s else 0.3 * v for v, s in zip(logit, size)]
        whole, parts = own[:], [abs(v) if s else 0.0 for v, s in zip(own, size)]
        for node in range(n - 1, -1, -1):
            parts[node] -= split_cost
            best = max(whole[node], -whole[node], parts[node])
            if node:
                whole[self.parents[node]] += whole[node]
                parts[self.parents[node]] += best
        state = [""] * n
        for node in range(n):
            above = state[self.parents[node]] if node else "split"
            if above != "split":
                state[node] = above
            elif parts[node] > abs(whole[node]):
                state[node] = "split"
            else:
                state[node] = "keep" if whole[node] > 0 else "drop"
        return "\n".join(t for node, t in self.blocks if state[node] == "keep" or state[node] == "split" and logit[node] > 0)


class Extractor:
    def __init__(self, odds: dict[str, float], trees: BoostedTrees, split_cost: float = 1.0):
        self.odds, self.trees, self.split_cost = odds, trees, split_cost

    def texts(self, pages: list[bytes]) -> list[str]:
        read = [Page(p.decode("utf-8", "replace")) for p in pages]
        rows, counts = [], []
        for page in read:
            own = page.features(self.odds) if page.blocks else []
            rows += own
            counts.append(len(own))
        logit = self.trees.logits(np.array(rows, np.float32)).tolist() if rows else []
        out, at = [], 0
        for page, count in zip(read, counts):
            out.append(page.kept(logit[at : at + count], self.split_cost) if count else "")
            at += count
        return out


def train(pages: list[str]) -> Extractor:
    """Fit on pages whose elements say ``data-main="1"`` or ``"0"``."""
    read = [Page(p) for p in pages]
    sides: dict[str, Counter] = defaultdict(Counter)
    labels = []
    for page in read:
        truth = [0] * len(page.tags)
        main, other = [0] * len(page.tags), [0] * len(page.tags)
        for node in range(1, len(page.tags)):
            own = page.truth[node]
            truth[node] = truth[page.parents[node]] if own is None else own
        for node, text in page.blocks:
            (main if truth[node] else other)[node] += len(text)
        for node in range(len(page.tags) - 1, 0, -1):
            main[page.parents[node]] += main[node]
            other[page.parents[node]] += other[node]
        share = [m / (m + o) if m + o else -1.0 for m, o in zip(main, other)]
        labels.append(share)
        for tokens, s in zip(page.tokens, share):
            if s >= 0:
                for token in set(tokens):
                    sides[token]["main" if s > 0.9 else "other" if s < 0.1 else "both"] += 1
    odds = {t: float(np.log((c["main"] + 1) / (c["other"] + 1))) for t, c in sides.items()}
    x = np.array([row for page in read for row in page.features(odds)], np.float32)
    share = np.concatenate(labels)
    clear = (share > 0.9) | ((share >= 0) & (share < 0.1))
    return Extractor(odds, BoostedTrees().fit(x[clear], (share[clear] > 0.9).astype(float)))


def fit(pages: DataFrame) -> Extractor:
    """An extractor trained on layouts filled with words of at most ``SAMPLE_PAGES`` pages."""
    from .layouts import laid_out

    short = pages.where(F.length("html") <= SAMPLE_CHARACTERS).select("page_id", "html")
    # ids first, so that only chosen pages reach the driver
    ids = short.select("page_id").orderBy(F.xxhash64(F.lit(23), "page_id"), "page_id").limit(SAMPLE_PAGES)
    chosen = short.join(F.broadcast(ids.distinct()), "page_id").limit(SAMPLE_PAGES)
    rows = sorted(chosen.collect(), key=lambda r: (r["page_id"], r["html"]))
    words = [w for r in rows for _, t in Page(r["html"]).blocks for w in t.split()]
    return train(laid_out(words, LAYOUTS))


def extract(pages: DataFrame, extractor: Extractor, keys: dict[str, Column] | None = None) -> DataFrame:
    """``page_id, url`` (or ``keys``), ``text`` and ``n_chars`` of each page."""
    keys = keys or {"page_id": F.col("page_id"), "url": F.col("url")}
    source = pages.select(*[c.alias(name) for name, c in keys.items()], F.col("html").cast("binary").alias("_html"))
    schema = source.drop("_html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("bigint")).schema
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for part in in_slices(batch.column("_html"), 2 << 20) for t in extractor.texts(part)]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return source.mapInArrow(run, schema)
