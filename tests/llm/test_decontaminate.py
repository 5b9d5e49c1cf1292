from __future__ import annotations

import random

from covenant.llm.decontaminate import SIMILARITY, contamination, without_contaminated
from tests.llm.cases import ODD, odd, shingles, words


def plain(docs: list[tuple], items: list[tuple]) -> dict[tuple, tuple]:
    """The best window of every document and item, by trying all."""
    found = {}
    for doc, text in docs:
        ours = words(text)
        for item, item_text in items:
            theirs = words(item_text)
            n, wanted = min(len(ours), len(theirs)), shingles(theirs, 5)
            for start in range(len(ours) - n + 1 if n else 0):
                window = shingles(ours[start : start + n], 5)
                both = sum((window & wanted).values())
                similarity = both / (sum(window.values()) + sum(wanted.values()) - both)
                if similarity >= SIMILARITY and similarity > found.get((doc, item), (0,))[0]:
                    found[doc, item] = (similarity, start)
    return found


def test_against_all_windows(spark):
    draw = random.Random(9)
    text = lambda n: [f"w{draw.randint(0, 400)}" for _ in range(n)]
    items = [(i, " ".join(text(draw.choice((1, 3, 5, 12, 40, 90, 120))))) for i in range(14)] + [(90, ""), (91, None), (92, "A B a b A B a b A B")]
    docs = []
    for i in range(120):
        body, item = text(draw.randint(0, 150)), words(draw.choice(items)[1])
        for _ in range(draw.choice((0, 0, 1, 1, 2, 3, 5)) if item else 0):
            change, at = draw.choice("rdi"), draw.randrange(len(item) or 1)
            item = item[:at] + ([] if change == "d" else text(1)) + item[at + (change != "i") :]
        at = draw.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + [w.upper() for w in item] * draw.choice((1, 1, 2)) + body[at:])))
    schema = "doc_id long, text string"
    found = contamination(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == {k: v for k, (v, _) in want.items()}
    assert len(want) > 40 and all(want[r["doc_id"], r["item_id"]][1] <= r["start"] for r in found)


def test_odd_rows(spark):
    docs, items = odd(spark), spark.createDataFrame([(1, "the same text twice and a second line"), (2, None)], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in contamination(docs, items).collect())
    assert found == [(5, 1, 1.0), (6, 1, 1.0)]
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ODD) - 3
    assert contamination(docs.limit(0), items).count() == 0
    assert contamination(docs, items.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(None, f"start {item} end"), (None, "nothing of it at all"), (1, f"before {item}"), (1, "a clean text"), (None, None)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in left)) == [(0, ""), (0, "nothing of it at all"), (1, "a clean text")]
