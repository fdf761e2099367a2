"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from vecstrata.llm import phrases
from vecstrata.llm.phrases import collocations


def plain_phrases(rows, least=30, most=2000):
    """The result for rows (lang, text)."""
    f = {}
    for lang, text in rows:
        mine = f.setdefault("und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    mine[words[i : i + n]] += 1
    out = []
    for lang, c in f.items():
        n = sum(k for p, k in c.items() if len(p) == 1)
        candidates = {p: k for p, k in c.items() if len(p) > 1 and k >= least}
        covered = {}
        for p, k in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(k, covered.get(p[i : i + m], 0))
        kept = []
        for p, a in candidates.items():
            if 100 * covered.get(p, -1) < 80 * a:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    text = lambda words, n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ", ", "\n"] if rng.random() < 0.2 else [" "]) for _ in range(n))
    common = ["the", "of", "The", "and", "naïve", "中文", "😀", "ÉA", "éa"]
    rows = [(rng.choice(["en", "fr", None, "und", "", "xx-long-name-en"]), text(common + [f"w{k}" for k in range(30)], 200)) for _ in range(60)]
    rows += [("en", "hot pair x " * 400), ("en", "hot pair " * 3000), (None, None), ("en", None), ("fr", ""), ("en", " \t\n"), ("en", "the of the of"), ("en", "..,;")]
    return rows + [rows[0]] * 3


SCHEMA = "lang string, text string, h bigint, slot string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "r") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("least", "most", "slots", "hot"), [(30, 2000, None, None), (3, 20, 7, 10), (2, 2000, 64, 3), (1, 50, 3, 1)])
def test_odd_rows(spark, odd, least, most, slots, hot):
    """Also where most words are hot, so that phrases are counted in several slots."""
    assert got(collocations(frame(spark, odd), least=least, most=most, slots=slots, hot=hot)) == plain_phrases(odd, least, most)


def test_small_blocks_and_a_full_filter(spark, odd, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 300)
    monkeypatch.setattr(phrases, "FILTER", 64)
    monkeypatch.setattr(phrases, "power_of_two", lambda n, low, high: 64)
    assert got(collocations(frame(spark, odd), least=3, hot=20)) == plain_phrases(odd, 3)


def test_a_shared_hash_is_noticed(spark, monkeypatch):
    rows = [("en", "a b a b a b"), ("fr", "a b a b")]
    true = phrases.seeds
    monkeypatch.setattr(phrases, "seeds", lambda names, seed: true(["same"] * len(names), seed) if seed == 0 else true(names, seed))
    df = spark.createDataFrame([(*r, 1, "s", "r") for r in rows], SCHEMA).coalesce(1)
    assert got(collocations(df, least=2)) == plain_phrases(rows, 2)


def test_no_rows(spark, odd):
    assert collocations(frame(spark, odd).limit(0)).collect() == []
    assert collocations(frame(spark, [(None, None)])).collect() == []


def test_counts_beyond_64_bits_when_multiplied(spark):
    """2000000 a passes 64 bits from some 4.6e12 on; the arithmetic is decimal."""
    row = spark.createDataFrame([(1, 2, 0, 0, 9 * 10**15)], "w0 bigint, w1 bigint, w2 bigint, w3 bigint, a bigint")
    single = spark.createDataFrame([(1, 0, 0, 0, 10**16), (2, 0, 0, 0, 9 * 10**15 + 7)], "w0 bigint, w1 bigint, w2 bigint, w3 bigint, a bigint")
    assert phrases._scored(row, single).first().score == 2000000 * 9 * 10**15 // (19 * 10**15 + 7)
