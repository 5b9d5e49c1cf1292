from __future__ import annotations

import random
import re
import re._parser as parser

from covenant.llm.license_rules import RULES
from covenant.llm.license_scan import scan_licenses
from tests.llm.cases import ODD, odd

PATTERNS = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in RULES]


def plain(text: str | None) -> tuple:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    padded = f" {' '.join(words)} "
    hits = []
    for i, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(padded):
            first = padded.count(" ", 0, m.start()) - 1
            hits.append((i, first, first + m[0].count(" ")))

    def hides(a, b) -> bool:
        one, two = RULES[a[0]].priority, RULES[b[0]].priority
        inside = a[1] <= b[1] and a[2] >= b[2]
        return inside and (one > two or one == two and (a[1:] != b[1:] or a[0] < b[0]))

    left = [h for h in hits if RULES[h[0]].base or not any(hides(o, h) for o in hits)]
    base = [h for h in left if RULES[h[0]].base]
    joined = lambda found: ",".join(sorted({RULES[h[0]].label for h in found}))
    firsts = [h[1] for h in base]
    return len(words), len(base), min(firsts, default=None), max(firsts, default=None), joined(base), joined(left), max((RULES[h[0]].score for h in left), default=0.0)


def sample(tree, draw: random.Random) -> str:
    """A text that a pattern matches."""
    out = ""
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            low, high = next(((v[0], v[1]) if str(k) == "RANGE" else (v, v)) for k, v in draw.sample(value, len(value)))
            out += chr(draw.randint(low, high))
        elif name == "SUBPATTERN":
            out += sample(value[-1], draw)
        elif name == "BRANCH":
            out += sample(draw.choice(value[1]), draw)
        elif name == "MAX_REPEAT":
            out += "".join(sample(value[2], draw) for _ in range(draw.randint(value[0], min(value[1], value[0] + 3))))
        else:
            raise AssertionError(name)
    return out


def samples(seed: int) -> list[str]:
    draw = random.Random(seed)
    return [sample(parser.parse(r.pattern), draw) for r in RULES]


def test_every_match_has_a_keyword():
    for seed in range(25):
        for rule, text in zip(RULES, samples(seed), strict=True):
            assert any(f" {keyword}" in f" {text}" for keyword in rule.keywords), (rule, text)


def test_against_all_rules(spark):
    draw, rows = random.Random(5), []
    for seed in range(3):
        made = samples(seed)
        for i, text in enumerate(made):
            spoken = "".join(c.upper() if draw.random() < 0.2 else c for c in text).replace(" ", draw.choice((" ", "-", ", ", "\n")))
            other = draw.choice(made)
            rows.append((1000 * seed + i, f"word {spoken} {draw.choice(('', 'é', 'and'))} {other}, {text}"))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert all(tuple(r)[1:] == plain(texts[r["doc_id"]]) for r in got) and len(got) == len(rows)
    assert sum(r["labels"] != "" for r in got) == len(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(texts)
    assert [tuple(r) for r in rows if tuple(r)[1:] != plain(texts[r["doc_id"]])] == []


def test_odd_rows(spark):
    docs = odd(spark)
    rows = scan_licenses(docs).collect()
    assert sorted(map(repr, (tuple(r)[1:] for r in rows))) == sorted(repr(plain(t)) for _, t, _ in ODD)
    assert scan_licenses(docs.limit(0)).count() == 0


def test_texts_without_the_license_s_name(spark):
    texts = {
        "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "agpl-3.0": "your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity",
        "ncsa": "to deal with the Software without restriction, including without limitation the rights to use",
        "cc-by-nc-sa-4.0": "see https://creativecommons.org/licenses/by-nc-sa/4.0/ for more",
        "json": "The Software shall be used for Good, not Evil.",
        "": "we may use the software for good and shall give credit to the authors of the document, without restriction",
    }
    found = scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in found} == {label: label for label in texts}
