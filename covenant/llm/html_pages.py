"""The labelled table for HTML extraction: pages of many layouts, in which data-main says what is main text.

The layouts are written by hand; words, lengths, class names and optional parts are drawn. data-main="yes" and "no" hold
for an element and what is in it, up to the next mark; the extraction never looks at that attribute otherwise.
"""

from __future__ import annotations

import random
from collections.abc import Callable

#: How many labelled pages the trees are fitted to.
TRAINING_PAGES = 420
_SYLLABLES = "an be cor da el fi gra hu in jo ka lo mé nu or pa que ri sün ta ur ve wo xi yo zañ".split()


class Draw(random.Random):
    def word(self) -> str:
        return "".join(self.choices(_SYLLABLES, k=self.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        text = " ".join(self.words(3, 18).capitalize() + self.choice(". . . . ? !".split()) for _ in range(self.randint(low, high)))
        if self.random() < 0.12:  # words with symbols, as in damaged text
            text = " ".join(w + self.choice(("***", "###", "&amp;&amp;", "$$$", "!!")) for w in text.split())
        return text.replace(" ", " &amp; ", 1) if self.random() < 0.1 else text

    def maybe(self, part: str, chance: float = 0.5) -> str:
        return part if self.random() < chance else ""

    def one(self, *parts: str) -> str:
        return self.choice(parts)

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{self.words(1, 3)}</a></{tag}>' for i in range(self.randint(low, high)))


def _menu(d: Draw) -> str:
    items = f"<ul>{d.links(3, 9)}</ul>"
    flat = " | ".join(f'<a href="/{i}">{d.word()}</a>' for i in range(d.randint(3, 8)))
    return d.one(
        f"<nav>{items}</nav>", f'<nav class="main-nav">{flat}</nav>', f'<div class="menu">{items}</div>',
        f'<div id="navigation">{flat}</div>', f'<ul class="topnav">{d.links(3, 8)}</ul>', items, f"<p>{flat}</p>",
        f'<div role="navigation">{items}</div>', f'<div class="x{d.randint(1, 9)}">{items}</div>',
    )


def _head(d: Draw) -> str:
    inner = f"<{d.one('div', 'h1', 'p', 'h2')}>{d.words(1, 4)}" + d.maybe(f"<p>{d.words(3, 9)}</p>", 0.3)
    inner += d.maybe(_menu(d), 0.6)
    return d.one(
        f"<header>{inner}</header>", f'<div id="header">{inner}</div>', f'<div class="site-header">{inner}</div>',
        f'<div class="masthead">{inner}</div>', f'<header role="banner" class="top">{inner}</header>', _menu(d),
    )


def _foot(d: Draw) -> str:
    rights = d.one("&copy; ", "&#169; 2024 ", "Copyright 2023 ", "(c) ") + d.words(1, 6)
    inner = d.one(
        rights, f"<p>{rights} &middot; {d.sentences(1, 2)}</p>", f"<ul>{d.links(2, 6)}</ul><p>{rights}</p>",
        f"{rights} &middot; {d.sentences(1, 1)}", f'<p>{rights}</p><p><a href="/">{d.words(1, 3)}</a> <a href="/">{d.word()}</a></p>',
        f"<div>{d.links(2, 5, 'span')}</div><div>{rights}</div>", d.sentences(1, 3),
    )
    return d.one(
        f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div id="footer">{inner}</div>',
        f'<div class="footer legal">{inner}</div>', f'<div class="site-footer">{inner}</div>', f"<hr><p>{rights}</p>",
    )


def _advert(d: Draw) -> str:
    text = d.one(d.sentences(1, 3), d.words(2, 9), f"<p>{d.sentences(1, 3)}</p>", f'<a href="/buy">{d.words(2, 7)}</a>')
    name = d.one("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement", "ad-slot")
    return d.one(f'<div class="{name}">{text}</div>', f'<aside class="{name}">{text}</aside>', f'<div id="{name}">{text}</div>', f'<section class="{name} box">{text}</section>')


def _notice(d: Draw) -> str:
    text = d.one(d.sentences(1, 2), f"<p>{d.sentences(1, 3)}</p>", f"<p>{d.sentences(1, 2)}</p><button>{d.word()}</button>")
    name = d.one("cookie-notice", "consent", "cookies", "notice", "alert", "popup", "gdpr-banner", "announcement", "cookie-banner")
    return d.one(f'<div class="{name}">{text}</div>', f'<div id="{name}" role="dialog">{text}</div>', f'<section class="{name}">{text}</section>', f'<p class="{name}">{d.sentences(1, 2)}</p>')


def _aside(d: Draw) -> str:
    inner = d.one(
        f"<h3>{d.words(1, 3)}</h3><ul>{d.links(3, 8)}</ul>", f"<h2>{d.words(1, 3)}</h2><p>{d.sentences(1, 3)}</p>",
        f"<p>{d.sentences(1, 4)}</p>", f"<div>{d.links(3, 8, 'p')}</div>", d.sentences(1, 2),
    )
    return d.one(
        f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="sidebar">{inner}</div>',
        f'<aside class="side">{inner}</aside>', f'<div class="widget-area"><div class="widget">{inner}</div></div>',
    )


def _form(d: Draw) -> str:
    fields = f'<label>{d.words(1, 3)}</label><input name="a">' * d.randint(1, 3)
    inner = d.maybe(f"<p>{d.sentences(1, 2)}</p>") + fields + f"<button>{d.word()}</button>"
    return d.one(f"<form>{inner}</form>", f'<form class="newsletter">{inner}</form>', f'<div class="subscribe"><h3>{d.words(2, 4)}</h3><form>{inner}</form></div>', f'<form id="search"><p>{fields}</p></form>', f'<div class="login-form">{inner}</div>')


def _comments(d: Draw) -> str:
    def one() -> str:
        tag = d.one("div", "li", "article")
        return f'<{tag} class="{d.one("comment", "comment-body", "reply", "c")}"><p class="meta"><b>{d.word()}</b></p><p>{d.sentences(1, 6)}</p></{tag}>'

    inner = f"<h{d.one('2', '3')}>{d.words(1, 3)}</h3>" * d.randint(0, 1) + "".join(one() for _ in range(d.randint(1, 6)))
    inner += d.maybe(_form(d), 0.3)
    return d.one(f'<section class="comments">{inner}</section>', f'<div id="comments">{inner}</div>', f'<div class="comment-list">{inner}</div>', f'<section id="reader-comments">{inner}</section>', f'<ol class="commentlist comments">{inner}</ol>')


def _related(d: Draw) -> str:
    inner = f"<h3>{d.words(1, 3)}</h3><ul>{d.links(2, 6)}</ul>"
    return d.one(f'<div class="related">{inner}</div>', f'<section class="recommended">{inner}</section>', f'<div class="share">{d.links(2, 5, "span")}</div>', f'<ul class="tags">{d.links(2, 6)}</ul>', f'<div class="breadcrumbs">{d.links(2, 4, "span")}</div>', f'<div class="pagination">{d.links(2, 6, "span")}</div>')


_JUNK: tuple[Callable[[Draw], str], ...] = (_advert, _notice, _aside, _form, _comments, _related, _menu)


def _paragraph(d: Draw) -> str:
    text = d.sentences(*d.choice(((1, 1), (1, 3), (2, 8), (4, 14))))
    if d.random() < 0.15:
        text = d.words(1, 6) + d.one(".", "", "")
    if d.random() < 0.2:
        text = text.replace(". ", f'. <a href="/x">{d.words(1, 4)}</a> ', 1)
    if d.random() < 0.15:
        text = f"<b>{text}" + d.one("</b>", "<br>", "")
    return f"<p>{text}" + d.one("</p>", "</p>", "</p>", "")


def _body(d: Draw) -> str:
    """An article's inner part; blocks that do not belong to it say so."""
    parts = [_paragraph(d) for _ in range(d.choice((1, 1, 2, 3, 4, 6, 9, 14)))]
    extras = [
        lambda: f"<h2>{d.words(1, 7)}</h2>",
        lambda: f"<ul>{''.join(f'<li>{d.sentences(1, 2)}</li>' for _ in range(d.randint(2, 6)))}</ul>",
        lambda: f"<ol>{''.join(f'<li>{d.words(2, 12)}' for _ in range(d.randint(2, 6)))}</ol>",
        lambda: f"<blockquote>{d.one(d.sentences(1, 4), '<p>' + d.sentences(1, 4) + '</p>')}</blockquote>",
        lambda: f"<figure><img src=a><figcaption>{d.sentences(1, 1)}</figcaption></figure>",
        lambda: "<table>" + "".join(f"<tr><td>{d.words(1, 4)}</td><td>{d.words(1, 4)}</td></tr>" for _ in range(d.randint(2, 5))) + "</table>",
        lambda: f"<pre>{d.words(4, 30)}</pre>",
        lambda: f"<div>{d.sentences(1, 6)}</div>",
        lambda: f"<section><h3>{d.words(1, 5)}</h3>{_paragraph(d)}{_paragraph(d)}</section>",
    ]
    for _ in range(d.choice((0, 0, 1, 2, 3))):
        parts.insert(d.randint(0, len(parts)), d.choice(extras)())
    for _ in range(d.choice((0, 0, 0, 1, 2))):
        junk = d.choice((_advert, _advert, _related, _notice, _form, _aside, _comments))(d)
        parts.insert(d.randint(1, len(parts)), _marked(junk, "no"))
    return "".join(parts)


def _marked(html: str, mark: str) -> str:
    """html with the mark in its first tag."""
    end = min(i for i in (html.find(">"), html.find(" ")) if i > 0)
    return f'{html[:end]} data-main="{mark}"{html[end:]}'


def _article(d: Draw) -> str:
    title = d.words(2, 10)
    heading = d.one(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", "")
    inner = heading + _body(d)
    name = d.one("content", "post", "entry-content", "article-body", "main-content", "story", "text", "page")
    return d.one(
        f'<article data-main="yes">{inner}</article>', f'<article data-main="yes">{inner}</article>',
        f'<article class="{name}" data-main="yes">{inner}</article>', f'<main data-main="yes">{inner}</main>',
        f'<main><article data-main="yes">{inner}</article></main>', f'<div class="{name}" data-main="yes">{inner}</div>',
        f'<div id="{name}"><div class="{name}" data-main="yes">{inner}</div></div>', f'<section data-main="yes">{inner}</section>',
        f'<div id="{name}" data-main="yes">{inner}</div>', f'<div data-main="yes">{inner}</div>',
    )


def page(d: Draw) -> str:
    title = f"<title>{d.words(2, 8)}</title>"
    head = f'<head><meta charset="utf-8">{title}<style>p{{margin:0}}</style><script>var a="</p>";</script></head>'
    before = [_head(d) if d.random() < 0.6 else _menu(d)] if d.random() < 0.95 else []
    before += [d.choice((_advert, _advert, _notice, _related, _form, _menu))(d) for _ in range(d.choice((0, 1, 1, 2)))]
    if d.random() < 0.5:
        before.insert(1, f"<!-- {d.word()} {d.randint(0, 99)} -->")
    after = [d.choice(_JUNK)(d) for _ in range(d.choice((0, 0, 1, 2)))]
    end = d.maybe(_foot(d), 0.95)
    middle = _article(d)
    if d.random() < 0.25:  # columns, in divisions or a table
        other = d.choice((_aside, _aside, _advert, _menu))(d)
        pair = [middle, other] if d.random() < 0.5 else [other, middle]
        tag = d.one("div", "div", "td")
        middle = "".join(f"<{tag}>{part}</{tag}>" for part in pair)
        middle = f"<table><tr>{middle}</tr></table>" if tag == "td" else f'<div class="{d.one("row", "wrap", "columns")}">{middle}</div>'
    if d.random() < 0.25:
        middle = f'<div class="{d.one("container", "wrapper", "page", "site")}">{middle}{"".join(after)}</div>'
        after = []
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{middle}{''.join(after)}{end}</body></html>"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    draw = Draw(seed)
    return [page(draw) for _ in range(n)]
