"""Labelled pages to train the extractor on: drawn from page layouts in common use, with invented words.

data-main="1" marks where the article begins, data-main="0" what is not part of it within."""

from __future__ import annotations

import random
from collections.abc import Iterator

# Class and id words that sites use for the parts of a page.
ARTICLES = ["content", "main-content", "post", "post-body", "entry-content", "article", "article-body", "story", "story-text", "page-content", "blog-post", "text", "body-copy", "entry"]
MENUS = ["nav", "menu", "navbar", "main-nav", "navigation", "breadcrumb", "breadcrumbs", "topnav", "site-nav", "pagination", "pager", "skip-links", "toc"]
HEADS = ["header", "site-header", "masthead", "banner", "topbar", "logo", "branding", "page-header"]
FEET = ["footer", "site-footer", "page-footer", "copyright", "colophon", "legal", "bottom"]
SIDES = ["sidebar", "side", "widget", "related", "related-posts", "recent-posts", "tags", "recommended", "trending", "popular", "author-box", "bio", "more-stories", "secondary"]
NOTICES = ["cookie", "cookie-notice", "consent", "gdpr", "alert", "notice", "cookie-banner", "popup", "modal", "newsletter", "subscribe", "promo", "signup", "paywall", "disclaimer"]
ADVERTS = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "ad-slot", "banner-ad", "adsbox", "promoted", "google-ad"]
COMMENTS = ["comments", "comment", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments", "comment-body"]
ONE_COMMENT = [*COMMENTS, "post", "entry", "message", "reply", "item", "text", "body", "content"]
SHARES = ["share", "social", "social-links", "share-buttons", "follow-us"]
WRAPPERS = ["wrapper", "container", "page", "row", "col", "layout", "inner", "grid", "site"]


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choice("aeioulnrst") for _ in range(self.rng.randint(2, 9))) for _ in range(n)).capitalize() + "." * stop

    def named(self, names: list[str], tag: str = "div") -> str:
        return f'{tag} {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(names)}"'

    def part(self, tags: list[str], names: list[str], inner: str, label: str = "") -> str:
        """Under its own tag, under a plain one with a class, or both."""
        tag = self.rng.choice([*tags, "div", "section"]) if tags else "div"
        opening = tag if tag in tags and self.rng.random() < 0.6 else self.named(names, tag)
        return f"<{opening}{label}>{inner}</{tag}>"

    def unknown(self) -> str:
        """A class that tells nothing: invented, or one of a builder's."""
        return "".join(self.rng.choice("abcdefghikmnoprtuxz") for _ in range(self.rng.randint(1, 9)))

    def linking(self) -> str:
        """A sentence with links in it."""
        return " ".join(f'{self.words(1, 9, False)} <a href="/z">{self.words(1, 4, False)}</a>' for _ in range(self.rng.randint(1, 4))) + f" {self.words(1, 6)}"

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4, stop=False)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.7 else " | ".join(items)

    def form(self) -> str:
        return f"<form{self.rng.choice(['', ' class=search', ' id=subscribe'])}><label>{self.words(1, 6, False)}</label><input name=q>{self.rng.choice(['<p>' + self.words(4, 14) + '</p>', ''])}</form>"

    def comments(self) -> str:
        one = lambda: f'<{self.named(ONE_COMMENT)}><p>{self.words(3, 40)}</p></div>' if self.rng.random() < 0.7 else f"<p>{self.words(3, 40)}</p>"
        head = f"<h{self.rng.choice('23')}>{self.words(1, 2, False)}</h3>" if self.rng.random() < 0.6 else ""
        return self.part(["section"], COMMENTS, head + "".join(one() for _ in range(self.rng.randint(1, 5))))

    def advert(self) -> str:
        return self.part([], ADVERTS, self.rng.choice([self.words(2, 25), f"<p>{self.words(4, 25)}</p>", f'<a href="/x">{self.words(2, 10)}</a>']))

    def notice(self) -> str:
        return self.part(["dialog"], NOTICES, self.rng.choice([f"<p>{self.words(5, 30)}</p>", self.words(5, 30), f"<p>{self.words(5, 20)} <a href=/p>{self.words(1, 2)}</a></p>", self.form()]))

    def side(self) -> str:
        return self.part(["aside"], SIDES, (f"<h3>{self.words(1, 4, False)}</h3>" if self.rng.random() < 0.5 else "") + self.rng.choice([self.links(5), f"<p>{self.words(4, 30)}</p>", f"<p>{self.words(4, 20)}</p>" + self.links(3)]))

    def footer(self) -> str:
        return self.part(["footer"], FEET, self.rng.choice(["&copy; ", "", "© "]) + self.rng.choice([self.words(3, 18), f"<p>{self.words(3, 20)}</p>", self.links(4)]))

    def paragraph(self) -> str:
        r, w = self.rng.random(), self.words
        if r < 0.1:
            return f"<p>{self.linking()}</p>"
        if r < 0.66:
            link = f' <a href="/y">{w(1, 3, False)}</a> ' if self.rng.random() < 0.2 else " "
            return f"<p>{self.rng.choice(['', '', '<b>'])}{w(*self.rng.choice([(1, 3), (1, 6), (3, 60), (3, 60), (30, 120)]), self.rng.random() < 0.8)}{link}{w(2, 60) if self.rng.random() < 0.6 else ''}" + self.rng.choice(["</p>", "</p>", "<br>"])
        if r < 0.74:
            return f"<h{(k := self.rng.choice('234'))}>{w(1, 8, False)}</h{k}>"
        if r < 0.86:
            item = lambda: w(*self.rng.choice([(1, 3), (2, 6), (4, 25)]), self.rng.random() < 0.4)
            return f"<{(k := self.rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{item()}</li>" for _ in range(self.rng.randint(2, 8))) + f"</{k}>"
        if r < 0.9:
            return f"<blockquote><p>{w(5, 40)}</p></blockquote>"
        if r < 0.93:
            return "<table>" + "".join(f"<tr><td>{w(1, 4, False)}</td><td>{w(1, 6, False)}</td></tr>" for _ in range(3)) + "</table>"
        if r < 0.96:
            return f"<figure><img src=x><figcaption>{w(3, 15)}</figcaption></figure>"
        return f"<div>{w(5, 50)}</div>"

    def within(self) -> str:
        """What stands in an article and is not of it."""
        kind = self.rng.choice(["advert", "side", "share", "form", "notice", "comments"])
        if kind == "share":
            x = self.part([], SHARES, self.links(4))
        elif kind == "form":
            x = self.form()
        else:
            x = getattr(self, kind)()
        return x.replace(" ", ' data-main="0" ', 1) if x.find(" ") < x.find(">") else x.replace(">", ' data-main="0">', 1)

    def article(self) -> str:
        rng = self.rng
        title = f"<h1>{self.words(3, 14, rng.random() < 0.4)}</h1>"
        if rng.random() < 0.2:
            title = f"<header>{title}</header>"
        elif rng.random() < 0.1:
            title = ""
        body = [self.paragraph() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 20]))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), self.within())
        if rng.random() < 0.25:  # a wrapper that tells nothing, or none
            inner = f'{title}{"".join(body)}'
            if rng.random() < 0.6:
                return f'<div {rng.choice(["class", "id"])}="{self.unknown()}" data-main="1">{inner}</div>'
            return f'<div data-main="1">{inner}</div>'
        tag, opening = rng.choice([("article", "article"), ("article", "article"), ("main", "main"), ("div", self.named(ARTICLES)), ("div", self.named(ARTICLES)), ("section", self.named(ARTICLES, "section")), ("article", self.named(ARTICLES, "article"))])
        return f'<{opening} data-main="1">{title}{"".join(body)}</{tag}>'

    def bare_page(self) -> str:
        """A page that is its text: no wrapper, and hardly anything around it."""
        blocks = self.rng.choice([[self.words(2, 60)], [f"<p>{self.words(1, 20)}</p>"], [f"<h1>{self.words(1, 8, False)}</h1>", *(self.paragraph() for _ in range(self.rng.randint(1, 6)))], [self.paragraph() for _ in range(self.rng.randint(1, 6))]])
        around = [x.replace(" ", ' data-main="0" ', 1) if x.find(" ") < x.find(">") else x.replace(">", ' data-main="0">', 1) for x in (self.part(["nav"], MENUS, self.links(4)), self.part(["footer"], FEET, self.links(3)))]
        before, behind = ((around[0] if self.rng.random() < 0.3 else ""), (around[1] if self.rng.random() < 0.3 else ""))
        return f'<html><body data-main="1">{before}{"".join(blocks)}{behind}</body></html>'

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.12:
            return self.bare_page()
        before = [self.part(["nav"], MENUS, self.links(rng.randint(3, 8)))] if rng.random() < 0.9 else []
        if rng.random() < 0.5:
            before.insert(rng.randint(0, len(before)), self.part(["header"], HEADS, self.rng.choice([f"<h1>{self.words(1, 4, False)}</h1><p>{self.words(2, 10)}</p>", f"<a href=/>{self.words(1, 3, False)}</a>", self.words(1, 8)])))
        for chance, make in ((0.6, self.advert), (0.4, self.notice), (0.3, self.side), (0.2, self.form)):
            if rng.random() < chance:
                before.insert(rng.randint(0, len(before)), make())
        behind = [make() for chance, make in ((0.35, self.comments), (0.4, self.side), (0.3, self.advert), (0.2, self.form), (0.2, self.notice), (0.9, self.footer)) if rng.random() < chance]
        middle = self.article()
        for _ in range(rng.choice([0, 0, 1, 2])):
            wrapper = rng.choice([self.named(WRAPPERS), "div", "main", self.named(WRAPPERS, "section")])
            middle = f"<{wrapper}>{self.side() if rng.random() < 0.3 else ''}{middle}{self.comments() if rng.random() < 0.2 else ''}</{wrapper.split()[0]}>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{''.join(before)}{middle}{''.join(behind)}</body></html>"


def pages(n: int = 1200, seed: int = 10) -> Iterator[str]:
    for i in range(n):
        yield Writer(seed * 1_000_003 + i).page()
