"""The label model and the scorer against plain versions, and what either decides."""

import math

import numpy as np
import pytest

from vecstrata.llm import quality as Q
from vecstrata.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"


def plain_posteriors(answers, rounds=400):
    """Expectation-maximisation over single documents, in dictionaries."""
    m = len(answers[0])
    post = [(a.count(1) + 1) / (a.count(1) + a.count(0) + 2) for a in answers]
    for _ in range(rounds):
        share = (sum(post) + 1) / (len(post) + 2)
        said = {}
        for k in range(m):
            for c in (0, 1):
                n = [Q.PRIOR + sum((p if c else 1 - p) for p, a in zip(post, answers, strict=True) if a[k] == v) for v in (0, 1)]
                said[k, c] = [x / sum(n) for x in n]
        old = post
        post = []
        for a in answers:
            odds = math.log(share / (1 - share)) + sum(math.log(said[k, 1][v] / said[k, 0][v]) for k, v in enumerate(a) if v < 2)
            post.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        if max(abs(x - y) for x, y in zip(old, post, strict=True)) < 1e-9:
            break
    return post


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_posteriors_match_a_plain_version(texts):
    answers = [Q.votes(Q.measures(t)).tolist() for _, t in texts[:400]]
    counts = {}
    for a in answers:
        counts[Q.key_of(np.array(a))] = counts.get(Q.key_of(np.array(a)), 0) + 1
    known = Q.WeakLabels(counts).known
    for a, p in zip(answers, plain_posteriors(answers), strict=True):
        assert known[Q.key_of(np.array(a))] == pytest.approx(p, abs=1e-6)


def test_scorer_matches_plain_gradient_descent():
    rng = np.random.default_rng(3)
    x, y = rng.random((40, 6)).astype(np.float32), rng.random(40)
    w = [0.0] * 7
    up, down = sum(v >= 0.5 for v in y), sum(v < 0.5 for v in y)
    for _ in range(25):
        slopes = [0.0] * 7
        for row, v in zip(x, y, strict=True):
            p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(row, w, strict=False)) + w[6])))
            g = (p - v) * (0.5 / up if v >= 0.5 else 0.5 / down)
            for k in range(6):
                slopes[k] += g * row[k]
            slopes[6] += g
        w = [a - 2.0 * (s + (1e-4 * a if k < 6 else 0)) for k, (a, s) in enumerate(zip(w, slopes, strict=True))]
    assert Q.fit(x, y, rounds=25) == pytest.approx(np.array(w), abs=1e-4)


def test_both_parts_decide(spark, texts):
    """Decisions are not those of a rule on the answers, nor all those of the label model."""
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in queries()["op4_quality"](spark, FOLDER).collect()}
    answers = {i: Q.votes(Q.measures(t)) for i, t in texts}
    no_complaint = {i: bool(t.split()) and not (answers[i] == 0).any() for i, t in texts}
    majority = {i: (a == 1).sum() > (a == 0).sum() for i, a in answers.items()}
    assert sum(no_complaint[i] != r.kept for i, r in rows.items()) > 0.01 * len(rows)
    assert any((r.posterior >= 0.5) != r.kept for r in rows.values())
    right = lambda kept: sum(kept[i] == bool(q) for i, q in truth.items()) / len(truth)
    figures = {"scorer": right({i: r.kept for i, r in rows.items()}), "labels": right({i: r.posterior >= 0.5 for i, r in rows.items()}), "none bad": right(no_complaint), "majority": right(majority)}
    print(figures)
    assert figures["scorer"] >= 0.97 and figures["scorer"] > max(figures["none bad"], figures["majority"])


def test_measures_of_odd_texts():
    for t in (b"", b" \n", b"x", b"\xff\xfe", b"a b " * 50_000, "é !".encode()):
        found = Q.measures(t)
        assert len(found) == len(Q.NAMES) == len(Q.BOUNDS) == len(Q.NEEDS) and np.isfinite(found).all() and np.isfinite(Q.vector(t, found)).all()
