"""Short benchmark items in prose that shares their vocabulary, and odd inputs of decontamination."""

import numpy as np

from vecstrata.llm import decontaminate as D

SIZES = (1, 3, 5, 7, 10, 15)


def test_short_items_are_all_found(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(3000)])
    odds = 1 / np.arange(1, 3001)
    prose = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    items = [(k, prose(SIZES[k % len(SIZES)])) for k in range(120)] + [(200 + k, prose(40)) for k in range(80)]
    docs = [(k, prose(300)) for k in range(200)]
    docs += [(1000 + k, prose(120) + " " + items[k][1].title() + ", " + prose(120)) for k in range(120)]
    padded = [(i, f" {' '.join(t.lower().replace(',', ' ').split())} ") for i, t in docs]
    want = {(i, j) for i, t in padded for j, item in items[:120] if f" {item} " in t}
    assert {(1000 + k, k) for k in range(120)} <= want
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert want <= got
    under = {j for j, t in items if len(t.split()) < D.SHORT}
    assert {(i, j) for i, j in got if j in under} == {(i, j) for i, j in want if j in under}


def test_long_documents_and_items(spark):
    rng = np.random.default_rng(7)
    prose = lambda n, of: " ".join(f"{of}{k}" for k in rng.integers(900, size=n))
    items = [(0, prose(3000, "a")), (1, "two words")]
    docs = [(0, prose(60_000, "b") + " " + items[0][1] + " " + prose(20_000, "b")), (1, prose(90_000, "b")), (2, "x " * 50_000 + "two words")]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(0, 0), (2, 1)}
