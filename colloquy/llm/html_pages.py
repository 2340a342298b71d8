"""Labelled pages that the content model of ``html_extract`` is trained on.

They are made by rule from the ways pages mark their parts up. Content is marked with
``MARK`` at the start of its text.
"""

from __future__ import annotations

import random

MARK = "\ue000"

# Class or id words by the part of a page that they name.
NAMES = {
    "header": ("header", "masthead", "top", "banner", "site-header", "branding"),
    "menu": ("nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "tabs", "toc", "pagination", "pager"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense", "sponsor"),
    "sidebar": ("sidebar", "side", "widget", "rail", "aside", "column-right", "secondary", "blogroll"),
    "notice": ("notice", "cookie", "cookies", "gdpr", "consent", "alert", "popup", "modal", "paywall", "disclaimer", "warning"),
    "comments": ("comments", "comment", "commentlist", "discussion", "replies", "disqus", "reader-comments", "responses", "user-comments", "comment-section"),
    "form": ("search", "newsletter", "login", "signup", "subscribe", "subscription", "contact-form", "register"),
    "related": ("related", "recommended", "more", "popular", "trending", "also", "share", "social", "tags", "teaser", "links"),
    "footer": ("footer", "bottom", "copyright", "legal", "site-footer", "colophon"),
    "content": ("content", "article", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content", "page-content"),
    "wrapper": ("page", "wrapper", "container", "row", "site", "layout", "outer", "inner", "wrap", "col"),
}
TAGS = {
    "header": ("header", "header", "div"),
    "menu": ("nav", "nav", "div", "ul"),
    "ad": ("div", "div", "aside", "section"),
    "sidebar": ("aside", "aside", "div"),
    "notice": ("div", "div", "section", "p", "dialog"),
    "comments": ("section", "div", "div", "ol"),
    "form": ("form", "form", "div"),
    "related": ("div", "section", "ul"),
    "footer": ("footer", "footer", "div"),
}
HIDDEN = 'style="display: none"'
SYLLABLES = ("an", "be", "ci", "do", "er", "fi", "ga", "ho", "in", "ka", "li", "mo", "ne", "or", "pa", "re", "st", "tu", "ün", "éc")


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)]
        for i in range(6, n - 1, self.r.randint(5, 12)):
            out[i] += self.r.choice(",,.;")
        return " ".join(out)

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.r.choice(("...", ".", ".", ".", "", "!", "?"))[:1]

    def mark(self, part: str) -> str:
        """Attributes that name a part."""
        name = self.r.choice(NAMES[part])
        if self.r.random() < 0.3:
            name += self.r.choice(("-box", "-area", "-1", "_block", " clearfix", "-container", " wide"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def wrap(self, part: str, inner: str) -> str:
        if part == "hidden":
            return f"<{(tag := self.r.choice(('p', 'div')))} {self.r.choice(('hidden', HIDDEN, HIDDEN))}>{inner}</{tag}>"
        tag = self.r.choice(TAGS[part])
        # A tag that says what it is needs no name; others have one.
        telling = tag in ("nav", "aside", "footer", "header", "form", "dialog")
        attrs = self.mark(part) if not telling or self.r.random() < 0.5 else ""
        if tag in ("ul", "ol") and not inner.startswith("<li"):
            inner = f"<li>{inner}</li>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, low: int, high: int, item: str = "li") -> str:
        return "".join(
            f'<{item}><a href="/{self.words(1, 1)}">{self.words(1, 4)}</a></{item}>' for _ in range(self.r.randint(low, high))
        )

    def heading(self) -> str:
        h = self.r.randint(2, 4)
        return f"<h{h}>{self.words(1, 3)}</h{h}>"

    def junk(self, part: str) -> str:
        r, s = self.r, self.sentence
        if part in ("menu", "related"):
            inner = self.links(2, 9)
            inner = f"<ul>{inner}</ul>" if r.random() < 0.7 else inner
            if part == "related":
                inner = self.heading() + (inner if r.random() < 0.7 else f"<p>{s(5, 30)}</p>")
            return self.wrap(part, inner)
        if part == "header":
            return self.wrap(part, r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{s(1, 9)}</p>", f'<a href="/">{self.words(1, 3)}</a>', s(1, 8))))
        if part == "ad":
            return self.wrap(part, r.choice((s(3, 40), f"<p>{s(3, 60)}</p>", f'<a href="/x">{s(2, 20)}</a>')))
        if part == "sidebar":
            return self.wrap(part, self.heading() * (r.random() < 0.5) + r.choice((f"<p>{s(5, 60)}</p>", f"<ul>{self.links(2, 6)}</ul>", s(3, 30))))
        if part == "notice":
            return self.wrap(part, r.choice((s(5, 50), f"<p>{s(5, 50)}</p>", f"{s(4, 30)} <button>{self.words(1, 2)}</button>")))
        if part == "hidden":
            return self.wrap(part, s(2, 40))
        if part == "comments":
            each = (f'<article class="comment"><p>{s(3, 70)}</p></article>', f'<div class="comment"><b>{self.words(1, 2)}</b><p>{s(3, 70)}</p></div>', f'<li class="comment"><p>{s(3, 70)}</p></li>', f"<p>{s(3, 70)}</p>")
            kind = r.randrange(4)
            return self.wrap(part, self.heading() * (r.random() < 0.5) + "".join(each[kind] for _ in range(r.randint(1, 5))))
        if part == "form":
            return self.wrap(part, f'<label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button>' + f"<p>{s(3, 25)}</p>" * (r.random() < 0.6))
        return self.wrap("footer", r.choice((f"&copy; {self.words(1, 3)} &middot; {s(2, 12)}", f"<p>{s(3, 30)}</p>", f"<ul>{self.links(2, 5)}</ul>")))

    def block(self) -> str:
        r, s = self.r, self.sentence
        kind = r.choices(("p", "one", "h", "list", "quote", "pre", "table", "figure", "bare", "bold"), (12, 3, 3, 2, 1, 1, 1, 1, 1, 2))[0]
        if kind == "p":
            text = s(4, 90)
            if r.random() < 0.3:
                text = text.replace(" ", f' <a href="/{self.words(1, 1)}">{self.words(1, 3)}</a> ', 1)
            return f"<p>{MARK}{text}</p>" if r.random() < 0.9 else f"<p>{MARK}{text}"
        if kind == "one":
            return f"<p>{MARK}{s(1, 3)}</p>"
        if kind == "h":
            return f"<h{(h := r.randint(2, 4))}>{MARK}{self.words(1, 7)}</h{h}>"
        if kind == "list":
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{MARK}{s(1, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if kind == "quote":
            return f"<blockquote><p>{MARK}{s(5, 40)}</p></blockquote>"
        if kind == "pre":
            return f"<pre>{MARK}{self.words(3, 30)}</pre>"
        if kind == "table":
            return "<table><tbody>" + "".join(f"<tr><td>{MARK}{self.words(1, 3)}</td><td>{MARK}{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</tbody></table>"
        if kind == "figure":
            return f"<figure><img><figcaption>{MARK}{s(3, 15)}</figcaption></figure>"
        if kind == "bare":
            return f"<div>{MARK}{s(8, 60)}<br>{s(3, 30)}</div>"
        return f"<p><b>{MARK}{s(2, 40)}<br>"

    def article(self) -> str:
        r = self.r
        head = f"<h1>{MARK}{self.words(1, 10)}</h1>" * (r.random() < 0.85)
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        body = [self.block() for _ in range(r.randint(1, 14))]
        for part in ("ad", "related", "comments", "form", "notice", "sidebar", "menu", "footer", "hidden"):
            if r.random() < 0.1:
                body.insert(r.randint(1, len(body)), self.junk(part))
        text = "".join(body)
        style = r.random()
        if style < 0.45:
            return f"<article{self.mark('content') if r.random() < 0.4 else ''}>{head}{text}</article>"
        if style < 0.6:
            return f"<main>{head}{text}</main>"
        if style < 0.9:
            name = f' {r.choice(("class", "id"))}="{r.choice(NAMES["content"])}"'
            tag = r.choice(("div", "div", "section"))
            return f"<{tag}{name}>{head}{text}</{tag}>" if r.random() < 0.6 else f"{head}<{tag}{name}>{text}</{tag}>"
        return f"<div>{head}{text}</div>" if style < 0.95 else head + text

    def page(self) -> str:
        r = self.r
        before = [self.junk(p) for p in ("header", "menu", "ad", "notice", "form") if r.random() < 0.45]
        after = [self.junk(p) for p in ("sidebar", "related", "comments", "ad", "form", "menu", "notice") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        foot = [self.junk("footer")] if r.random() < 0.8 else []
        body = "".join([*before, self.article(), *after, *foot])
        if r.random() < 0.4:
            body = f'<div class="{r.choice(NAMES["wrapper"])}">{body}</div>'
        head = f"<head><title>{self.words(1, 5)}</title><script>x='</p>'</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + "</body></html>" * (r.random() < 0.9)


def labelled_pages(count: int, seed: int = 2) -> list[str]:
    """Pages whose content leaves start with ``MARK``."""
    pages = Pages(seed)
    return [pages.page() for _ in range(count)]
