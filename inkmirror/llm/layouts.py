"""Training pages for the main-text extractor: many layouts, each part known.

Every element of an article says ``data-main="1"``, every other part ``"0"``; words come
from real pages. Parts vary in tags, in names of classes, in order and in nesting, and
are sometimes left without any class, so that structure has to speak for itself.
"""

from __future__ import annotations

import numpy as np

# Usual class and id names of page parts.
NAMES = {
    "nav": "nav menu navbar navigation main-nav topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toolbar skip-links".split(),
    "header": "header site-header masthead topbar branding banner logo page-head".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-foot credits".split(),
    "sidebar": "sidebar aside widget related related-posts recommended popular trending right-col rail secondary tags share social-share social promo-list".split(),
    "notice": "notice cookie cookie-notice cookie-banner consent alert gdpr message popup modal overlay disclaimer warning info-bar announcement".split(),
    "ad": "ad ads advert advertisement ad-slot ad-banner sponsored sponsor promo promotion banner-ad commercial dfp adsbygoogle".split(),
    "form": "form newsletter subscribe signup search search-form login contact-form mailing-list".split(),
    "comments": "comments comment comment-list reader-comments responses discussion replies disqus comment-thread user-comments respond".split(),
    "main": "article content post entry story main post-content entry-content article-body story-body body-text text page-content main-content".split(),
    "wrap": "wrapper container page site layout row col wrap outer inner grid".split(),
}


class _Layout:
    def __init__(self, words: list[str], draw: np.random.Generator):
        self.words, self.draw = words, draw
        self.named = draw.random() < 0.8  # else no class names at all
        self.semantic = draw.random() < 0.6  # else all parts are div

    def pick(self, values):
        return values[int(self.draw.integers(len(values)))]

    def chance(self, p: float) -> bool:
        return bool(self.draw.random() < p)

    def phrase(self, low: int, high: int) -> str:
        many = int(self.draw.integers(low, high))
        begin = int(self.draw.integers(max(1, len(self.words) - many)))
        return " ".join(self.words[begin : begin + many]).replace("&", "&amp;").replace("<", "&lt;")

    def sentence_text(self, low: int, high: int) -> str:
        text = self.phrase(low, high)
        if self.chance(0.3):
            text = f"<{(t := self.pick(['b', 'em', 'span', 'strong', 'i']))}>{text}</{t}> {self.phrase(3, 12)}"
        if self.chance(0.25):
            text += f' <a href="/{self.pick(self.words[:50])}">{self.phrase(1, 4)}</a> {self.phrase(3, 15)}'
        return text

    def attributes(self, kind: str, named: float = 0.9) -> str:
        if not (self.named and self.chance(named)):
            return ""
        name = self.pick(NAMES[kind])
        if self.chance(0.2):
            name += " " + self.pick(NAMES["wrap"])
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def part(self, kind: str, tag: str, inner: str, main: int = 0) -> str:
        tag = tag if self.semantic else "div"
        # a plain tag without a name is known by its place only; name it more often
        return f'<{tag}{self.attributes(kind, 0.95 if tag == "div" else 0.5)} data-main="{main}">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.phrase(1, 4)}</a>' for i in range(int(self.draw.integers(low, high)))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.pick([" ", " | ", " &middot; ", "<br>"]).join(items)

    def nav(self) -> str:
        return self.part("nav", "nav", self.links(3, 9))

    def header(self) -> str:
        return self.part("header", "header", f'<a href="/">{self.phrase(1, 4)}</a>' + (f"<p>{self.phrase(2, 8)}</p>" if self.chance(0.5) else ""))

    def footer(self) -> str:
        text = f"&copy; {self.phrase(1, 3)} &middot; {self.phrase(2, 20)}"
        if self.chance(0.5):
            text = f"<p>{text}</p>" + self.links(2, 6)
        return self.part("footer", "footer", text)

    def ad(self) -> str:
        return self.part("ad", self.pick(["div", "div", "aside", "section"]), self.pick(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(self.phrase(2, 20)))

    def notice(self) -> str:
        return self.part("notice", self.pick(["div", "div", "aside", "section", "dialog"]), self.pick(["{}", "<p>{}</p>"]).format(self.phrase(4, 30)) + ("<button>OK</button>" if self.chance(0.5) else ""))

    def sidebar(self) -> str:
        inner = f"<h3>{self.phrase(1, 4)}</h3>" + self.links(3, 8)
        if self.chance(0.5):
            inner += f"<p>{self.phrase(5, 30)}</p>"
        return self.part("sidebar", "aside", inner)

    def form(self) -> str:
        inner = f'<label>{self.phrase(1, 4)}</label><input name="q"><button>{self.phrase(1, 2)}</button>'
        if self.chance(0.6):
            inner = f"<p>{self.phrase(3, 15)}</p>" + inner
        return f'<form{self.attributes("form")} data-main="0">{inner}</form>'

    def comments(self) -> str:
        def one() -> str:
            text = f"<p>{self.sentence_text(4, 40)}</p>"
            author = f"<{(t := self.pick(['b', 'span', 'h4', 'div']))}>{self.phrase(1, 3)}</{t}>"
            return self.pick(["<li{a}>{x}</li>", "<div{a}>{x}</div>", "<article{a}>{x}</article>"]).format(a=self.attributes("comments"), x=author + text)

        inner = "".join(one() for _ in range(int(self.draw.integers(1, 6))))
        tag = self.pick(["section", "div", "div", "ol"])
        kind = self.pick(NAMES["comments"])
        return f'<{tag} {self.pick(["class", "id"])}="{kind}" data-main="0"><h3>{self.phrase(1, 3)}</h3>{inner}</{tag}>'

    def article(self) -> str:
        blocks = [f"<h1>{self.phrase(2, 12)}</h1>"]
        if self.chance(0.15):
            blocks[0] = f"<header>{blocks[0]}</header>"
        for _ in range(int(self.draw.integers(0, 14))):
            roll = self.draw.random()
            if roll < 0.72:
                text = f"<p>{self.sentence_text(1, 90)}"
                # closing tags are often left out
                blocks.append(text + ("" if self.chance(0.2) else "</p>"))
            elif roll < 0.78:
                blocks.append(f"<h{(n := self.pick([2, 3]))}>{self.phrase(1, 8)}</h{n}>")
            elif roll < 0.84:
                blocks.append("<ul>" + "".join(f"<li>{self.sentence_text(2, 20)}</li>" for _ in range(int(self.draw.integers(2, 6)))) + "</ul>")
            elif roll < 0.88:
                blocks.append(f"<blockquote><p>{self.phrase(5, 40)}</p></blockquote>")
            elif roll < 0.91:
                blocks.append(f"<pre>{self.phrase(5, 40)}</pre>")
            elif roll < 0.94:
                rows = "".join(f"<tr><td>{self.phrase(1, 5)}</td><td>{self.phrase(1, 5)}</td></tr>" for _ in range(3))
                blocks.append(f"<table>{rows}</table>")
            elif roll < 0.96:
                blocks.append(f'<figure><img src="/i.png"><figcaption>{self.phrase(3, 15)}</figcaption></figure>')
            elif roll < 0.98:
                blocks.append(self.ad())
            else:
                blocks.append(self.pick([self.sidebar, self.form, self.notice])())
        inner = "".join(blocks)
        if self.chance(0.3):
            inner = blocks[0] + f"<div{self.attributes('main', 0.8)}>" + "".join(blocks[1:]) + "</div>"
        tag = self.pick(["article", "article", "article", "main", "section", "div"]) if self.semantic else "div"
        if self.chance(0.25):
            inner += self.comments()
        return f'<{tag}{self.attributes("main", 0.4 if tag == "article" else 0.97)} data-main="1">{inner}</{tag}>'

    def page(self) -> str:
        title = self.phrase(2, 10)
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>"
        before = [self.header] * self.chance(0.4) + [self.nav] * self.chance(0.85) + [self.notice] * self.chance(0.25) + [self.ad] * self.chance(0.5)
        after = [self.comments] * self.chance(0.3) + [self.sidebar] * self.chance(0.4) + [self.ad] * self.chance(0.25) + [self.form] * self.chance(0.2) + [self.nav] * self.chance(0.1)
        if self.chance(0.2) and after:
            before, after = before + after[:1], after[1:]
        body = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if self.chance(0.5):
            body = f'<div{self.attributes("wrap")}>{body}</div>'
        if self.chance(0.85):
            body += self.footer()
        return head + f'<div data-main="0">{body}</div>' if self.chance(0.3) else head.replace("<body>", '<body data-main="0">') + body + "</body></html>" * self.chance(0.8)


def laid_out(words: list[str], count: int, seed: int = 9) -> list[str]:
    draw = np.random.default_rng(seed)
    words = words or ["text"]
    return [_Layout(words, draw).page() for _ in range(count)]
