"""Labelled pages to learn main text from: many layouts, with each run of text marked as main or not.

The pages are made from a seed. Main runs carry a mark at their beginning that is taken out before
the page is used, so labels come from the page as it was parsed.
"""

from __future__ import annotations

import random

import numpy as np

from millrace.llm.dom import Page

MARK = "\ue000"
LETTERS = "etaoinshrdlucmfwypvbgkqxzäéñö"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lexicon = ["".join(self.r.choices(LETTERS, range(len(LETTERS), 0, -1), k=self.r.randint(1, 10))) for _ in range(400)]

    def some(self, *options: str) -> str:
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choices(self.lexicon, k=self.r.randint(least, most)))

    def sentences(self, least: int, most: int) -> str:
        n, out = self.r.randint(least, most), []
        while n > 0:
            k = min(n, self.r.randint(1, 18))
            out.append(self.words(k, k).capitalize().replace(" ", ", " if self.chance(0.1) else " ", 1) + ".")
            n -= k
        return " ".join(out)

    def prose(self, style: int) -> str:
        text = self.sentences(*self.r.choice([(1, 3), (2, 12), (10, 60), (40, 160)]))
        if style == 1:
            return text.upper().replace(" ", "!! ") + "!!"
        if style == 2:
            return " ".join(w + self.some("***", "###", "%%%", "$$$", "&amp;&amp;&amp;") for w in text.split())
        if style == 3:
            return " | ".join(text.split())
        if style == 4:
            return " ".join(w for w in text.split()[:6] for _ in range(self.r.randint(5, 30)))
        return text

    def named(self, tag: str, names: list[str], inner: str, always: bool = False) -> str:
        attribute = ""
        if always or self.chance(0.8):
            name = self.some(*names)
            if self.chance(0.3):
                name = self.some("site-", "page-", "x-", "wp-", "c-") + name
            if self.chance(0.3):
                name += self.some(" wide", " box", "-wrap", " clearfix", "-1")
            attribute = f' {self.some("class", "class", "id")}="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, least: int, most: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 4)}</a></li>' for _ in range(self.r.randint(least, most))) + "</ul>"

    def menu(self) -> str:
        inner = self.links(3, 12) if self.chance(0.8) else " | ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(6))
        return f"<nav>{inner}</nav>" if self.chance(0.6) else self.named(self.some("div", "nav", "ul"), ["menu", "nav", "navbar", "navigation", "breadcrumbs", "top-menu"], inner, True)

    def header(self) -> str:
        inner = self.some("<h1>", "<div>", "<p>", "<span>") + self.words(1, 8) + self.some("", "<p>" + self.sentences(1, 15) + "</p>") + (self.menu() if self.chance(0.4) else "")
        return f"<header>{inner}</header>" if self.chance(0.6) else self.named("div", ["header", "masthead", "topbar", "banner", "branding"], inner, True)

    def footer(self) -> str:
        inner = self.some("&copy; ", "", "Copyright ") + self.words(1, 6) + " &middot; " + self.sentences(1, 40) + (self.links(2, 6) if self.chance(0.4) else "")
        if self.chance(0.5):
            inner = f"<p>{inner}</p>"
        return f"<footer>{inner}</footer>" if self.chance(0.7) else self.named("div", ["footer", "site-footer", "colophon", "bottom", "copyright"], inner, True)

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" * self.chance(0.6) + (self.links(2, 8) if self.chance(0.5) else f"<p>{self.sentences(3, 60)}</p>")
        return self.named("aside", ["sidebar", "related", "widget", "more"], inner) if self.chance(0.6) else self.named(self.some("div", "section"), ["sidebar", "related", "widget", "rail", "recommended", "trending", "side"], inner, True)

    def advert(self) -> str:
        inner = self.sentences(1, 40)
        return self.named(self.some("div", "div", "section", "aside", "p"), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor"], self.some(inner, f"<p>{inner}</p>", f'<a href="/x">{inner}</a>'), True)

    def notice(self) -> str:
        inner = self.sentences(2, 40) + self.some("", "<button>" + self.words(1, 2) + "</button>")
        return self.named(self.some("div", "div", "section", "aside", "p", "dialog"), ["notice", "cookie", "cookie-banner", "consent", "alert", "popup", "gdpr", "paywall", "modal"], self.some(inner, f"<p>{inner}</p>"), True)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 5)}</label><input name=q>" + f"<p>{self.sentences(2, 30)}</p>" * self.chance(0.5) + f"<button>{self.words(1, 2)}</button>" + f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>" * self.chance(0.3)
        return self.named("form", ["search", "newsletter", "subscribe", "login"], inner) if self.chance(0.8) else self.named("div", ["newsletter", "subscribe", "search", "signup", "login"], inner, True)

    def comments(self) -> str:
        one = lambda: self.named(self.some("div", "li", "article", "p", "section"), ["comment", "reply", "comment-body", "review"], self.some(self.words(1, 2), f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>") + self.some("<p>{}</p>", "{}", "<div>{}</div>").format(self.sentences(2, 90)))
        inner = f"<h2>{self.words(1, 3)}</h2>" * self.chance(0.7) + "".join(one() for _ in range(self.r.randint(1, 6))) + (self.form() if self.chance(0.3) else "")
        return self.named(self.some("section", "div", "div", "ol", "aside"), ["comments", "comment-list", "commentlist", "discussion", "disqus", "reader-comments", "respond", "reviews", "thread"], inner, True)

    def share(self) -> str:
        return self.named(self.some("div", "ul", "p"), ["share", "social", "sharing", "follow", "toolbar"], " ".join(f'<a href="/s">{self.words(1, 2)}</a>' for _ in range(4)), True)

    def main(self) -> str:
        style = self.r.choice([0, 0, 0, 0, 1, 2, 3, 4])
        m, out = MARK, []
        if self.chance(0.85):
            title = f"<h1>{m}{self.prose(style)[:60] if self.chance(0.5) else self.words(1, 10)}</h1>"
            out.append(f"<header>{title}</header>" if self.chance(0.05) else title)
        for k in range(self.r.choice([1, 1, 2, 4, 8, 15, 30])):
            p = self.r.random()
            text = m + self.prose(style)
            if p < 0.72:
                if self.chance(0.15):
                    text = text.replace(" ", f' <a href="/l">{self.words(1, 3)}</a> ', 1)
                out.append(self.some(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"))
            elif p < 0.8:
                out.append(f"<h2>{m}{self.words(1, 8)}</h2>")
            elif p < 0.86:
                tag = self.some("ul", "ol")
                out.append(f"<{tag}>" + "".join(f"<li>{m}{self.sentences(1, 20)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>")
            elif p < 0.9:
                out.append(f"<blockquote>{self.some('', '<p>')}{text}</blockquote>")
            elif p < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif p < 0.96:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<figure><img src=x><figcaption>{m}{self.words(2, 12)}</figcaption></figure>" if self.chance(0.5) else f"<pre>{text}</pre>")
            if k and self.chance(0.05):
                out.append(self.r.choice([self.advert, self.notice, self.form, self.share, self.side])())
        if self.chance(0.08):
            out.append(self.comments())
        inner = "".join(out)
        if self.chance(0.2):
            inner = self.some("<div>{}</div>", "<section>{}</section>", '<div class="{}">{{}}</div>'.format(self.some("body", "text", "entry", "post-body"))).format(inner)
        kind = self.r.random()
        if kind < 0.6:
            return self.named("article", ["post", "article", "story", "entry"], inner) if self.chance(0.4) else f"<article>{inner}</article>"
        if kind < 0.75:
            return f"<main>{inner}</main>"
        return self.named(self.some("div", "div", "section"), ["content", "main", "post", "article", "entry-content", "story-body", "main-content", "article-body"], inner, True)

    def page(self) -> str:
        before = [x() for x, p in ((self.header, 0.35), (self.menu, 0.65), (self.notice, 0.2), (self.advert, 0.4), (self.form, 0.1), (self.side, 0.12)) if self.chance(p)]
        after = [x() for x, p in ((self.share, 0.15), (self.comments, 0.35), (self.side, 0.3), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.15), (self.menu, 0.1)) if self.chance(p)]
        self.r.shuffle(after)
        middle = self.main()
        if self.chance(0.3):
            wrap = self.some("<main>{}</main>", "<div>{}</div>", '<div class="container">{}</div>', '<div id="page"><div class="row">{}</div></div>', '<div id="content">{}</div>', "<section>{}</section>")
            k = self.r.randint(0, len(after))
            middle = wrap.format(middle + "".join(after[:k]))
            after = after[k:]
        foot = self.footer() if self.chance(0.85) else ""
        body = "".join([*before, middle, *after, foot])
        if self.chance(0.2):
            body = self.some('<div class="wrapper">{}</div>', "<div>{}</div>", '<div id="root">{}</div>').format(body)
        head = f"<head><meta charset=utf-8><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}" + "</body></html>" * self.chance(0.85)


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of so many pages, and whether a node holds main text."""
    maker, xs, ys = Maker(seed), [], []
    for _ in range(pages):
        page = Page(maker.page())
        holds = np.zeros(len(page.kind))
        for node, text in zip(page.run_node, page.run_text, strict=True):
            if MARK in text:
                holds[node] = 1
        page.run_text = [t.replace(MARK, "") for t in page.run_text]
        for i in range(len(holds) - 1, 0, -1):
            holds[page.parent[i]] = max(holds[page.parent[i]], holds[i])
        xs.append(page.features())
        ys.append(holds)
    return np.concatenate(xs), np.concatenate(ys)
