"""Fingerprints against a plain sketch, plain sets, and sorted rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vecstrata.llm import fingerprints as fp
from vecstrata.llm.fingerprints import difference, fingerprints, let


def digests(text):
    lines = []
    for x in text.split("\n"):
        lines += __import__("re").split("[.!?] ", x) if len(x) > 1000 else [x]
    return {int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines if x}


def check(x):
    return ((x % 2147483647) * 1000003 + (x % 998244353) * 7919) % 4294967296


def cells(items):
    out = [[0, 0, 0] for _ in range(24)]
    for x in items:
        for row in range(3):
            c = out[8 * row + (x >> (20 + 3 * row) & 7)]
            c[:] = c[0] + 1, c[1] ^ x, c[2] ^ check(x)
    return " ".join(":".join(map(str, c)) for c in out)


def plain(rows):
    """The result for rows (doc_id, text) with different ids, or different texts of one id whose order does not matter."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = digests(t), digests(edited), digests(after)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), edited, cells(a), cells(b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["naïve", "中文", "😀", "word", "a.", "b! c"]) for _ in range(rng.randrange(1, 9)))
    texts = ["\n".join(line() for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 21, 34, 55, 90, 150] * 12]
    texts += [None, "", "\n\n", "one line", "x", " ", "same\nsame\nsame", "\n".join(str(k) for k in range(3000)), "sentence here. " * 200 + "end", "y " * 50_000]
    return [(k * 3, t) for k, t in enumerate(texts)] + [(1, texts[5]), (-7, texts[5]), (None, "no id\nat all"), (2**63 - 1, "largest"), (-(2**63), "least")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", "g") for r in rows], "doc_id bigint, text string, n_chars int, range string, own string").repartition(5)


def test_odd_rows(spark, rows, monkeypatch):
    want = plain(rows)
    assert got(fingerprints(frame(spark, rows))) == want
    monkeypatch.setattr(fp, "RANGE", 500)
    monkeypatch.setattr(fp, "LEAST_ROWS", 1)
    assert got(fingerprints(frame(spark, rows))) == want


def test_few_rows(spark):
    for rows in ([(1, "a\nb")], [(None, None)], [(1, "a\nb"), (2, "c")], [(5, "p\nq")] * 3):
        assert got(fingerprints(frame(spark, rows))) == plain(rows)
    assert fingerprints(frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_equal_texts_have_equal_fingerprints(spark, rows):
    texts = [t for _, t in rows]
    by = {}
    for r in fingerprints(frame(spark, list(enumerate(texts + texts)))).collect():
        by.setdefault(r.doc_id % len(texts), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(texts)


def test_peeling_recovers_differences_and_retries_larger(spark, monkeypatch):
    """With all retries peeling alone finds every difference; with fewer some sketches are left over, and none is read wrongly."""
    rng = random.Random(9)
    draw = lambda n: [rng.getrandbits(60) for _ in range(n)]
    cases = []
    for common in (0, 5, 200):
        for a, b in ((0, 0), (1, 0), (0, 3), (4, 4), (20, 5), (60, 80), (500, 400)):
            shared = draw(common)
            cases.append((a, b, shared + draw(a), shared + draw(b)))
    df = spark.createDataFrame(cases, "n int, m int, a array<bigint>, b array<bigint>")
    for retries in (10, 1, 0):
        monkeypatch.setattr(fp, "RETRIES", retries)
        out = df.select("n", "m", F.expr(let("struct(a, b)", "pair", difference("pair"))).alias("d")).collect()
        assert all((r.d.mine, r.d.theirs) == (r.n, r.m) for r in out)
        left = [r for r in out if r.d.compared]
        assert (not left) if retries == 10 else left and all(r.n + r.m > 4 for r in left)


def test_no_python_on_the_way(spark, rows):
    plan = fingerprints(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), plan
