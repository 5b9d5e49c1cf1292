from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest

from covenant.llm.boosting import fit
from covenant.llm.html_pages import labelled_pages
from covenant.llm.html_text import Page, decode, extract, main_text, trained


def marked_text(html: str) -> str:
    page, inside, out = Page(html), [], []
    for node, mark in enumerate(page.marks):
        up = page.parent[node]
        inside.append("yes" in mark if mark else up >= 0 and inside[up])
        if inside[node] and page.text[node]:
            out.append(page.text[node])
    return "\n".join(out)


def test_held_out_pages():
    held = labelled_pages(150, seed=99)
    right = sum(main_text(html, trained()) == marked_text(html) for html in held)
    assert right >= 140


def test_whole_table(spark):
    """The given pages hold their text in one article element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in extract(pages).collect()}
    for page in pages.collect():
        article = re.search("<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert rows[page["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert rows[page["page_id"]]["url"] == page["url"]


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<p>a&nbsp;&lt;b&gt;\n c<br>d</p>e", ["a <b> c d", "e"]),
        ("<p>one<p>two <b>bold</p> tail", ["one", "two bold", "tail"]),
        ("<ul><li>a<li>b <ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><div>yes</div>", ["yes"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("</div></p>text < 3 and <unknown>more</unknown>", ["text < 3 and more"]),
        ("<div title='a > b' class=\"x>y\">t</div><textarea>no</textarea><script>open", ["t"]),
        ("<p", ["<p"]),
        ("<p title=it's>Hello</p><p>don't</p>", ["Hello", "don't"]),
        ('<p class="x>Broken</p><p>next', ["Broken", "next"]),
        ('<p "odd" = ==b a="c > d" / e>x', ["x"]),
        ("<p>so <math><mi>x</mi>=2</math> holds</p><canvas>a chart</canvas>", ["so x=2 holds", "a chart"]),
        ("<video src=a.mp4>told in words</video><noscript><p>plain</p></noscript>", ["told in words", "plain"]),
        ("", []),
    ],
)
def test_blocks(html, blocks):
    assert [t for t in Page(html).text if t] == blocks


def test_decoding_is_the_best_consistent_choice():
    html = "<div>a<div>b<p>c</p></div></div><p>d</p>"
    page, draw = Page(html), np.random.default_rng(3)
    n = len(page.kind)
    for _ in range(60):
        score = draw.normal(0, 2, n)
        best = max(
            (k for k in range(1 << n) if all(not k >> i & 1 or k >> page.parent[i] & 1 for i in range(1, n))),
            key=lambda k: sum(-np.log1p(np.exp(-score[i] if k >> i & 1 else score[i])) for i in range(n)),
        )
        assert decode(page, score) == [page.text[i] for i in range(n) if best >> i & 1 and page.text[i]]


def test_boosting_fits_an_interaction():
    rows = np.random.default_rng(0).normal(size=(2000, 4))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 2] > 0.5)).astype(float)
    trees = fit(rows[:1500], labels[:1500], np.ones(1500), rounds=40)
    assert ((trees.score(rows[1500:]) > 0) == labels[1500:]).mean() > 0.95


def test_odd_rows(spark):
    rows = [(None, None, None, "t"), (1, "u", "", "t"), (2, "u", "<p>" * 3000 + "deep", "t"), (3, "u", "x" * 200_000, "t"), (3, "u", "x" * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert [r["text"] for r in out.collect() if r["page_id"] in (None, 1)] == ["", ""]
    assert out.count() == len(rows) and extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("<html><head><title>no</title><meta charset=a><body><article><p>yes</p></article>", ["yes"]),
        ("<head><style>p{}</style><script>'</p>'</script><p>one<p>two", ["one", "two"]),
        ("<head><title>no</title></head><p>yes", ["yes"]),
        ("<div><button>go</div><p>yes</p><button>no</button><p>more</p>", ["go", "yes", "more"]),
        ("<p>a</p><svg><svg><text>no</text></svg><text>no</text></svg><p>b</p><svg/><p>c</p>", ["a", "b", "c"]),
        ("<object data=x><p>a</p><video src=y><p>b</p><noscript>c", ["a", "b", "c"]),
        ("<button><!-- </button> --><script>'</button>'</script>no</button><p>yes</p>", ["yes"]),
        ("<p>a</p><script>no<p>no", ["a"]),
    ],
)
def test_elements_without_an_end_tag_do_not_swallow_the_page(html, blocks):
    assert [t for t in Page(html).text if t] == blocks
