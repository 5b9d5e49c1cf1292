"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no kept node lies in a dropped one.

A page becomes a tree of its block elements, with a leaf for each block of text. Every node gets features: kind of
element, tokens of class, id and role, depth, place among its siblings, and what its subtree holds (text, links, blocks,
headings, inputs). Trees trained on a table of labelled pages (html_pages.py, TRAINING_PAGES pages) give each
node the log-odds of holding main text. Decoding then takes the likeliest consistent choice for the whole page: a node
may be kept only if its parent is. Blocks that are kept are joined in page order.

What never is text (scripts, styles, the title, form controls, drawings, frames) is left out when the page is read. Other
opaque elements than raw text are only left out up to their own end tag; without one, what follows is read. Formulas and
what media elements hold for readers without them are text like any other.
Pages are independent rows: nothing is shuffled, and memory per task is one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.boosting import Trees, fit

#: Names with or without a value, as browsers read them: a quote opens a value only right after the equals sign, and only
#: if there is a second one.
_ATTRIBUTES = r"""(?>(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)"""
_OPAQUE = "script|style|title|textarea|template|svg|iframe|select|button"
#: Comments, declarations, elements whose content is no text, and tags.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(?P<opaque>{_OPAQUE})(?=[\s/>]){_ATTRIBUTES}>"
    rf"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})>",
    re.S | re.I,
)
#: Opaque elements that hold raw text: their first end tag ends them, or the page does.
_RAW = ("script", "style", "title", "textarea")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
#: Tags of the other opaque elements, past comments and raw text.
_PAIRS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(_RAW)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>{'|'.join(t for t in _OPAQUE.split('|') if t not in _RAW)})(?=[\s/>])(?P<attributes>{_ATTRIBUTES})>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

_KINDS = (
    "article main section div p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd nav header footer aside form fieldset table tbody "
    "thead tfoot tr td th blockquote pre figure figcaption body html address details summary center hr dialog menu hgroup"
).split()
_GROUPS = [
    ["article"], ["main"], ["section"], ["div", "center"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6", "hgroup"],
    ["li", "dt", "dd"], ["ul", "ol", "dl"], ["nav", "menu"], ["header"], ["footer"], ["aside"],
    ["form", "fieldset", "dialog"], ["table", "tbody", "thead", "tfoot", "tr"], ["td", "th"],
    ["blockquote", "pre", "figure", "figcaption"], ["body", "html"], ["#text"],
]
_GROUP = {kind: i for i, kinds in enumerate(_GROUPS) for kind in kinds}
_BLOCKS = frozenset(_KINDS)
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag ends if they are open, and where the search for them stops.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_SCOPES = frozenset("table td th body html".split())

#: Words of class, id and role, by what they tell.
_TOKENS = [
    "article content main post entry body story text page prose",
    "nav navigation menu breadcrumb breadcrumbs navbar tabs toc pagination pager topnav submenu",
    "footer foot bottom copyright legal colophon imprint",
    "header head top masthead banner logo branding contentinfo",
    "sidebar side aside rail widget widgets complementary column",
    "ad ads advert advertisement adbox sponsor sponsored promo promotion dfp adsense teaser commercial",
    "cookie cookies consent gdpr notice alert popup modal overlay announcement warning message dialog",
    "comment comments reply replies respond disqus discussion reader feedback reviews",
    "related share sharing social recommended recommend more links tags tag follow popular trending",
    "form login signup subscribe newsletter search register signin contact",
]
_TOKEN_BIT = {word: 1 << i for i, words in enumerate(_TOKENS) for word in words.split()}
_HIDDEN = 1 << len(_TOKENS)
_N_BITS = len(_TOKENS) + 1


def _bits(attributes: str) -> int:
    found = 0
    if not attributes:
        return found
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            found |= _HIDDEN
        elif name in ("class", "id", "role"):
            for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value):
                found |= _TOKEN_BIT.get(word.lower(), 0)
    return found


def _ends(html: str) -> dict[int, int]:
    """Where opaque elements without raw text end, by the end of their first tag; those without an end tag are not in it."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for token in _PAIRS.finditer(html):
        if tag := token["tag"]:
            stack = open_at.setdefault(tag.lower(), [])
            if token["close"]:
                if stack:
                    ends[stack.pop()] = token.end()
            elif not (tag.lower() == "svg" and token["attributes"].endswith("/")):
                stack.append(token.end())
    return ends


class Page:
    """The block elements of a page and the blocks of text, in page order, as parallel lists."""

    def __init__(self, html: str) -> None:
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.bits: list[int] = []
        self.above: list[int] = []
        self.groups_above: list[int] = []
        self.depth: list[int] = []
        self.link: list[int] = []
        self.inputs: list[int] = []
        self.text: list[str | None] = []
        self.marks: list[str] = []
        self._read(html)

    def _add(self, group: int, parent: int, bits: int, text: str | None, marks: str = "") -> int:
        at = len(self.kind)
        self.kind.append(group)
        self.parent.append(parent)
        self.last.append(at)
        self.bits.append(bits)
        self.above.append(self.above[parent] | self.bits[parent] if parent >= 0 else 0)
        self.groups_above.append(self.groups_above[parent] | 1 << self.kind[parent] if parent >= 0 else 0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.link.append(0)
        self.inputs.append(0)
        self.text.append(text)
        self.marks.append(marks)
        return at

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", self._add(_GROUP["html"], -1, 0, None))]
        parts: list[str] = []
        linked = links = 0
        at, n = 0, len(html)
        ends: dict[int, int] | None = None

        def end_block() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.link[self._add(_GROUP["#text"], stack[-1][1], 0, text)] = min(linked, len(text))
            linked = 0

        def end_element(place: int) -> None:
            end_block()
            while len(stack) > place:
                self.last[stack.pop()[1]] = len(self.kind) - 1

        def close_open(names: set[str], limits: frozenset[str] | set[str]) -> None:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place][0] in names:
                    return end_element(place)
                if stack[place][0] in limits:
                    return None

        while at < n:
            token = _TOKEN.search(html, at)
            start = token.start() if token else n
            if start > at:
                part = html[at:start]
                part = unescape(part) if "&" in part else part
                parts.append(part)
                linked += len(part.strip()) if links else 0
            if token is None:
                break
            at = token.end()
            if opaque := token["opaque"]:
                if opaque.lower() in _RAW:
                    end = _ENDS[opaque.lower()].search(html, at)
                    at = end.end() if end else n
                else:
                    ends = _ends(html) if ends is None else ends
                    at = ends.get(at, at)  # without an end tag, what follows is read as if the tag were not there
                self.inputs[stack[-1][1]] += opaque.lower() in ("textarea", "select", "button")
                continue
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                links = 0 if token["close"] else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "input":
                self.inputs[stack[-1][1]] += 1
            elif tag not in _BLOCKS:
                continue
            elif tag in ("html", "body"):
                self.bits[0] |= _bits(token["attributes"]) & ~_HIDDEN
            elif token["close"]:
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place][0] == tag:
                        end_element(place)
                        break
                else:
                    end_block()
                links = 0 if tag not in ("p", "li") else links
            else:
                end_block()
                close_open({"p"}, _SCOPES)
                if tag in _CLOSES:
                    close_open(_CLOSES[tag], _LIMITS[tag])
                if tag not in _EMPTY:
                    attributes = token["attributes"]
                    mark = attributes if "data-main" in attributes else ""
                    stack.append((tag, self._add(_GROUP.get(tag, _GROUP["div"]), stack[-1][1], _bits(attributes), None, mark)))
        end_element(0)


def _sums(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What each node's subtree adds up to: subtrees are stretches of nodes in page order."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[last + 1] - total[np.arange(len(values))]


def features(page: Page) -> np.ndarray:
    kind, parent, last = np.array(page.kind), np.array(page.parent), np.array(page.last)
    n, every = len(kind), np.arange(len(kind))
    chars = np.array([len(t) if t else 0 for t in page.text], float)
    ends = np.array([sum(map(t.count, ".!?,;")) if t else 0 for t in page.text], float)
    rights = np.array([bool(t) and ("©" in t or "(c)" in t.lower()) for t in page.text], float)
    leaf, link = (kind == _GROUP["#text"]).astype(float), np.array(page.link, float)
    size, links, blocks, inputs = (_sums(v, last) for v in (chars, link, leaf, np.array(page.inputs, float)))
    stops, paragraphs, heads = (_sums(v, last) for v in (ends, (kind == _GROUP["p"]) * 1.0, ((kind == 5) | (kind == 6)) * 1.0))
    before = np.concatenate(([0.0], np.cumsum(chars)))[:-1]
    total = max(size[0], 1.0)
    siblings = np.bincount(parent[1:], minlength=n)[np.maximum(parent, 0)]
    order = np.argsort(parent, kind="stable")
    rank = np.empty(n)
    rank[order] = every - np.searchsorted(parent[order], parent[order])
    alike = np.zeros(n)
    _, inverse, count = np.unique(parent * 64 + kind, return_inverse=True, return_counts=True)
    alike = count[inverse] / np.maximum(siblings, 1)
    bits, above, groups = np.array(page.bits), np.array(page.above), np.array(page.groups_above)
    density = links / np.maximum(size, 1)
    up = np.maximum(parent, 0)
    columns = [*((kind == g) for g in range(len(_GROUPS)))]
    columns += [(bits >> b) & 1 for b in range(_N_BITS)] + [(above >> b) & 1 for b in range(_N_BITS)]
    columns += [(groups >> _GROUP[k]) & 1 for k in ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "p", "h2", "td")]
    columns += [np.array(page.depth), rank, siblings, rank / np.maximum(siblings, 1), alike, np.log1p(size), density, blocks]
    columns += [size / np.maximum(blocks, 1), size / np.maximum(last - every + 1, 1), stops / np.maximum(blocks, 1)]
    columns += [stops / np.maximum(size, 1), paragraphs, heads, inputs, size / total, before / total, _sums(rights, last) > 0]
    columns += [np.log1p(size[up]), density[up], paragraphs[up], blocks[up], size[up] / total, kind[up] == _GROUP["p"], kind[up] == 5]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def decode(page: Page, score: np.ndarray) -> list[str]:
    """The kept blocks under the likeliest choice in which the parents of kept nodes are kept."""
    n = len(score)
    keep = np.minimum(score, 0) - np.log1p(np.exp(-np.abs(score)))
    drop = keep - score
    drops = _sums(drop, np.array(page.last))
    best = keep.tolist()
    drops, parent = drops.tolist(), page.parent
    for node in range(n - 1, 0, -1):
        best[parent[node]] += max(best[node], drops[node])
    kept, out = [True] * n, []
    for node in range(n):
        kept[node] = (node == 0 or kept[parent[node]]) and best[node] > drops[node]
        if kept[node] and page.text[node]:
            out.append(page.text[node])
    return out


@cache
def trained() -> Trees:
    """The trees, fitted once a process to the labelled pages; a node's label is whether main text lies in it."""
    from covenant.llm.html_pages import labelled_pages

    rows, labels, weights = [], [], []
    for html in labelled_pages():
        page = Page(html)
        label = np.zeros(len(page.kind))
        inside = [False] * len(page.kind)
        for node in range(len(page.kind)):
            mark, up = page.marks[node], page.parent[node]
            inside[node] = "yes" in mark if mark else up >= 0 and inside[up]
            if inside[node] and page.text[node]:
                while node >= 0 and not label[node]:
                    label[node] = 1
                    node = page.parent[node]
        filled = _sums(np.array([bool(t) for t in page.text], float), np.array(page.last)) > 0
        rows.append(features(page)[filled]), labels.append(label[filled]), weights.append(np.ones(int(filled.sum())))
    return fit(np.concatenate(rows), np.concatenate(labels), np.concatenate(weights))


def main_text(html: str | None, trees: Trees) -> str:
    page = Page(html or "")
    if len(page.kind) == 1:
        return ""
    return "\n".join(decode(page, trees.score(features(page))))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The columns of pages but html_col and text_col, and the main text of each page as text_col.

    Null and empty pages have an empty text. Repeated rows are read each; all other columns are carried along as they
    are. An empty table stays empty. Markup without an end, stray tags and unknown elements are read as far as they go.
    """
    trees = trained()
    rest = [c for c in pages.columns if c not in (html_col, text_col)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Page(h.as_py() or "") for h in batch.column(len(rest))]
            rows = [features(page) for page in read]
            score = trees.score(np.concatenate(rows)) if rows else np.zeros(0)
            ends = np.cumsum([len(r) for r in rows]).tolist()
            texts = ["\n".join(decode(p, score[e - len(r) : e])) for p, r, e in zip(read, rows, ends, strict=True)]
            arrays = [*batch.columns[: len(rest)], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, text_col])

    taken = pages.select(*rest, F.col(html_col).cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema[: len(rest)]), f"`{text_col}` string"])
    return taken.mapInArrow(each, schema)
