"""Labelled pages to train the extraction model on: invented text in many page layouts, main text marked node by node."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi tu ren sal vo dar pe ni sho bra gel tin um or ast eck".split()
MENU = ["nav", "menu", "main-nav", "navbar", "breadcrumb", "site-menu", "toc", "pagination"]
ADS = ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot", "banner-ad"]
NOTES = ["cookie-notice", "consent", "alert", "notice", "gdpr-banner", "popup", "site-warning"]
TALK = ["comments", "comment-list", "disqus", "responses", "discussion", "replies"]
SIDE = ["sidebar", "widget", "related", "recommended", "share", "social-links", "tags", "popular-posts", "author-box"]
FORMS = ["search", "newsletter", "login-form", "subscribe", "contact-form"]
HEADS, FEET = ["header", "masthead", "topbar", "site-header", "branding"], ["footer", "site-footer", "foot", "colophon", "copyright"]
MAIN = ["content", "article", "main", "post", "entry-content", "story", "article-body", "text", "blog-post", "mw-content"]
NEUTRAL = ["wrap", "container", "inner", "row", "col-8", "box", "c1", "grid", "section-2", "block", ""]


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def text(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        mark = self.r.choice([" | ", ". ", ", ", " "]) if self.chance(0.1) else None
        out, since = [], 0
        for k in range(n):
            w = self.word()
            if since == 0:
                w = w.capitalize()
            since += 1
            if mark is None and (k == n - 1 or self.chance(0.09)):
                w, since = w + self.r.choice(".....?!:"), 0
            elif mark is None and self.chance(0.07):
                w += ","
            out.append(w)
        return (mark or " ").join(out)

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for k in range(len(words)):
            if self.chance(0.03):
                words[k] = f"<{(t := self.r.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>{words[k]}</{t}>"
            elif self.chance(0.02):
                words[k] = f'<a href="/{words[k]}">{words[k]}</a>'
        return ("<b>" if self.chance(0.1) else "") + " ".join(words) + ("<br>" if self.chance(0.1) else "")

    def named(self, names: list[str], sure: float = 0.8) -> str:
        name = self.r.choice(names) if self.chance(sure) else self.r.choice(NEUTRAL)
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def wrap(self, tag: str, attributes: str, inner: str, main: int | None = None) -> str:
        return f"<{tag}{attributes}{'' if main is None else f' data-main="{main}"'}>{inner}</{tag}>"

    def list_of_links(self, low: int = 3, high: int = 12, words: int = 2) -> str:
        items = [f'<a href="/{self.word()}">{self.text(1, words)}</a>' for _ in range(self.r.randint(low, high))]
        if self.chance(0.2):
            return self.r.choice([" | ", " &middot; ", " "]).join(items)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def menu(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul", "table"])
        inner = self.list_of_links()
        if tag == "table":
            inner = "<tr>" + "".join(f'<td><a href="/x">{self.text(1, 2)}</a></td>' for _ in range(5)) + "</tr>"
        return self.wrap(tag, self.named(MENU, 0.4 if tag == "nav" else 0.9), inner, 0)

    def advert(self) -> str:
        inner = self.text(3, 30) if self.chance(0.7) else f'<p>{self.text(3, 20)}</p><a href="//x">{self.text(1, 3)}</a>'
        return ("<!-- ad -->" if self.chance(0.3) else "") + self.wrap(self.r.choice(["div", "div", "aside", "section", "p"]), self.named(ADS, 1), inner, 0)

    def notice(self) -> str:
        return self.wrap(self.r.choice(["div", "section", "aside", "dialog"]), self.named(NOTES, 1), f"<p>{self.text(5, 40)}</p>" if self.chance(0.5) else self.text(5, 30), 0)

    def side(self) -> str:
        parts = [self.r.choice(["<h3>{}</h3>", "<h4>{}</h4>", "<p>{}</p>"]).format(self.text(1, 4)), self.list_of_links(2, 8, 8)]
        if self.chance(0.3):
            parts.append(f"<p>{self.text(5, 40)}</p>")
        tag = self.r.choice(["aside", "aside", "div", "section"])
        return self.wrap(tag, self.named(SIDE, 0.5 if tag == "aside" else 1), "".join(parts), 0)

    def talk(self) -> str:
        one = lambda: self.wrap(self.r.choice(["div", "li", "article"]), self.named(["comment", "reply"], 0.7), f"<p>{self.text(4, 60)}</p>")
        inner = ("<h3>" + self.text(1, 3) + "</h3>") * self.chance(0.5) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.wrap(self.r.choice(["div", "section", "ol"]), self.named(TALK, 1), inner, 0)

    def form(self) -> str:
        inner = f"<label>{self.text(1, 3)}</label><input name=q><p>{self.text(2, 15)}</p><button>{self.text(1, 2)}</button>"
        return self.wrap("form", self.named(FORMS, 0.7), inner, 0)

    def head(self) -> str:
        inner = self.r.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "{}"]).format(self.text(1, 6)) + (self.menu() if self.chance(0.4) else "")
        tag = self.r.choice(["header", "header", "div"])
        return self.wrap(tag, self.named(HEADS, 0.4 if tag == "header" else 1), inner, 0)

    def foot(self) -> str:
        inner = f"&copy; {self.word()}.example &middot; {self.text(2, 25)}" if self.chance(0.6) else self.list_of_links() + f"<p>{self.text(3, 20)}</p>"
        tag = self.r.choice(["footer", "footer", "div"])
        return self.wrap(tag, self.named(FEET, 0.4 if tag == "footer" else 1), inner, 0)

    def block(self) -> str:
        low, high = self.r.choice([(1, 6), (8, 40), (20, 120), (60, 250)])
        kind = self.r.random()
        text = self.inline(self.text(low, high))
        if kind < 0.7:
            return f"<p>{text}" + ("</p>" if self.chance(0.85) else "")
        if kind < 0.78:
            return f"<{(h := self.r.choice(['h2', 'h3']))}>{self.text(1, 9)}</{h}>"
        if kind < 0.86:
            return f"<{(t := self.r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.inline(self.text(2, 25))}</li>" for _ in range(self.r.randint(2, 7))) + f"</{t}>"
        if kind < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.text(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{self.text(3, 15)}</figcaption></figure>"
        return f"<div>{text}</div>" if kind < 0.98 else f"<pre>{text}</pre>"

    def article(self) -> str:
        parts = [f"<h1>{self.text(2, 12)}</h1>"] if self.chance(0.85) else []
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 15, 30])):
            parts.append(self.block())
            if self.chance(0.05):
                parts.append(self.r.choice([self.advert, self.side, self.notice, self.form])())
        if self.chance(0.15):
            parts.append(self.talk())
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        body = self.wrap(tag, self.named(MAIN, 0.4 if tag in ("article", "main") else 0.9), "".join(parts), 1)
        return self.wrap("div", self.named(MAIN + NEUTRAL, 1), body, 1) if self.chance(0.3) else body

    def page(self) -> str:
        before = [x() for x in (self.notice, self.head, self.menu, self.advert, self.form) if self.chance(0.45)]
        after = [x() for x in (self.side, self.talk, self.advert, self.form, self.menu, self.foot) if self.chance(0.4)]
        if self.chance(0.6):
            after.append(self.foot())
        if self.chance(0.3):
            self.r.shuffle(before)
        if self.chance(0.2):
            before.append(self.side())
        inner = "".join(before) + self.article() + "".join(after)
        if self.chance(0.4):
            inner = self.wrap("div", self.named(NEUTRAL, 1), inner, 1)
        return f'<!DOCTYPE html><html data-main="1"><head><title>{self.text(2, 9)}</title></head><body>{inner}' + "</body></html>" * self.chance(0.9)


def pages(count: int, seed: int) -> list[str]:
    return [Writer(seed * 1_000_003 + k).page() for k in range(count)]
