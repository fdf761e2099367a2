"""Near copies of the pipeline's stage against brute-force similarity."""

from collections import defaultdict

import numpy as np
from brute import components

import corpus_pipeline
from vecstrata.llm.similar import _bins, _may_be


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def kept(rows):
    """Ids that stay, by the similarity of all pairs that share a shingle."""
    sets, holds, near = [shingle_set(t) for _, t in rows], defaultdict(list), set()
    for k, s in enumerate(sets):
        for x in s or {None}:
            holds[x].append(k)
    seen = {(i, j) for ks in holds.values() for i in ks for j in ks if j < i}
    near = {(i, j) for i, j in seen if similar(sets[i], sets[j])}
    ids = [i for i, _ in rows]
    label = ids[:]
    for _ in ids:
        old = label[:]
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    return {i for i, k in zip(ids, label, strict=True) if i == k}


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert made.columns == docs.columns
    got, want = {r.doc_id for r in made.collect()}, kept(rows)
    assert got == want and 56 not in got


def test_stage_on_edited_texts(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base[:59], "x"]), " ".join(["y", *base[1:59], "x"]), " ".join([*base[:30], "z", *base[31:]]), " ".join([*base[:20], "z", *base[21:40], "z", *base[41:]])]
    texts += ["Only four words here", "only  four words HERE", None, " ", "a b c d e f g h i", "a b c d e f g h j", "a b c d e f"]
    texts += [" ".join([*(f"t{k}_{j}" for j in range(40)), *base[:10]]) for k in range(40)]
    texts += [" ".join(f"g{j}" if j != k else "q" for j in range(100)) for k in range(0, 100, 2)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sets = [shingle_set(t) for t in texts]
    label = components([i for i, _ in rows], lambda i, j: similar(sets[i], sets[j]))
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == set(label)


def test_bins_never_rule_out_similar_sets():
    r, ruled_out = np.random.default_rng(1), 0
    for _ in range(500):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 400))).astype(np.uint64))
        k = int(r.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([a[k:], r.integers(0, 1 << 63, int(r.integers(0, k + 2))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        bins = np.stack([np.frombuffer(_bins(x), np.uint8) for x in (a, b)])
        may = _may_be(0.8, bins, np.array([len(a), len(b)]), np.array([0]), np.array([1]))[0]
        assert may or common < 0.8 * (len(a) + len(b) - common)
        ruled_out += not may
    assert ruled_out > 100
