"""Sharding, scoring, quality, extraction, licenses and decontamination."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import common_length

from vecstrata.llm import decontaminate as D
from vecstrata.llm.html_extract import blocks, extract, main_text, minimum_cut, train
from vecstrata.llm.licenses import TEMPLATES, Scanner, licenses
from vecstrata.llm.lm_score import score
from vecstrata.llm.quality import keep_good, judge
from vecstrata.llm.quality import train as train_quality
from vecstrata.llm.queries import queries
from vecstrata.llm.sharding import interleaved_shards
from vecstrata.llm.words import hashed_words

FOLDER = "/root/testdata/sf0.001"


# -- sharding


def check_shards(rows, source, shards):
    n = len(rows)
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.get(k, 0) for k in range(shards)) <= 1
    for k in by:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(by[k]))
    assert sum(by.values()) == n
    for s, c in Counter(r.source for r in rows).items():
        for k in range(shards):
            assert abs(sum(r.source == s and r.shard == k for r in rows) - c / shards) <= 2


def test_shards(spark, docs, nothing):
    rows = interleaved_shards(docs, shards=3).collect()
    check_shards(rows, "source", 3)
    texts = Counter((r.doc_id, 1 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert interleaved_shards(nothing).count() == 0


def test_shards_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = interleaved_shards(docs).collect()
    check_shards(rows, "source", 8)
    again = {(r.doc_id, r.shard, r.slot) for r in interleaved_shards(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    import hashlib

    place = {}
    for s in {r.source for r in rows}:
        mine = sorted((int(hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest()[:13], 16), r.doc_id) for r in rows if r.source == s)
        place |= {i: ((2 * k + 1) / (2 * len(mine)), "s" + s, i) for k, (_, i) in enumerate(mine)}
    order = sorted(place, key=place.get)
    assert {(i, k * 8 // len(order)) for k, i in enumerate(order)} == {(r.doc_id, r.shard) for r in rows}


# -- words and scores


def test_word_hashes():
    texts = ["Ab c", "", "ab  C\n", "c,ab", "é É x1"]
    h, bounds = hashed_words([t.encode() for t in texts])
    words = [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert words[0] == words[2] and words[3] == words[0][::-1] and words[1] == [] and len(set(words[4])) == 3


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from vecstrata.llm import words

    texts = [b"some words, of " * 40 + b"x" * 50, b"", b"and others"]
    whole = hashed_words(texts)
    monkeypatch.setattr(words, "CHUNK", 8)
    assert (hashed_words(texts)[0] == whole[0]).all() and (hashed_words(texts)[1] == whole[1]).all()


def plain_loss(texts, wanted, asked, bigram=0.6, add=0.5):
    """Word bigrams counted in dictionaries over the vocabulary of all texts: losses per token of target and background."""
    import re

    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, pairs, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for t, w in zip(texts, wanted, strict=True):
        mine = cut(t)
        for k in ([0, 1] if w else [1]):
            words[k].update([None, *mine] if mine else [])
            pairs[k].update(zip([None, *mine], mine))
            total[k] += len(mine) + bool(mine)
    scale, out, vocabulary = [1.0, total[0] / total[1]], [], len(words[1])  # the start sign is one of them
    for t in asked:
        mine, loss = cut(t), [0.0, 0.0]
        for pair in zip([None, *mine], mine):
            for k in range(2):
                p = bigram * pairs[k][pair] / words[k][pair[0]] if words[k][pair[0]] else 0
                loss[k] -= math.log(p + (1 - bigram) * (words[k][pair[1]] * scale[k] + add) / (total[k] * scale[k] + add * vocabulary))
        out.append((len(mine), [x / len(mine) for x in loss] if mine else None))
    return out


def test_target_texts_score_lower(spark):
    rows = [(k, " ".join(f"{'a' if k % 2 else 'b'}{(k * 7 + j) % 30}" for j in range(60))) for k in range(40)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k,) for k in range(1, 20, 2)], "doc_id bigint")).collect()}
    assert max(got[k] for k in range(1, 40, 2)) < min(got[k] for k in range(0, 40, 2))


def test_scores_of_odd_rows(spark, docs, nothing):
    target = spark.createDataFrame([(8,), (8,), (99,), (None,)], "doc_id bigint")
    got = score(docs, target).collect()
    assert len(got) == docs.count() and all((r.n_tokens == 0) == (r.score is None) for r in got)
    best = {r.doc_id: r.score for r in got if r.score is not None}
    assert best[8] == best[9] < best[13]
    assert all(r.score in (0.0, None) for r in score(docs, target.limit(0)).collect())
    assert score(nothing, target).count() == 0


# -- quality


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries()["op4_quality"](spark, folder).collect() if r.doc_id in truth]
    assert sum(r.kept == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert sum(r.kept for r in got if truth[r.doc_id]) >= 0.99 * sum(truth[r.doc_id] for r in got)


def test_labellers_are_weighed(spark):
    model = train_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert (model.labels.accuracy() > 0.6).all() and 0.7 < model.labels.share < 0.95


def test_quality_of_odd_rows(docs, nothing):
    got = judge(docs, train_quality(docs)).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.doc_id in (0, 1, 2))
    kept = keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert keep_good(nothing).count() == judge(nothing, train_quality(nothing)).count() == 0


# -- extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{}</style></head><body><header><h1>Site</h1><a href=x>Home</a></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div id="cookie-notice"><p>We use cookies, and you agree to all of them by reading this page at all.</p></div>
<div class="wrap"><article><h2>A title &amp; more</h2><p>This is the first paragraph of the story, with <b>enough words to look<br>like text.<p>Short one.</p><!-- no --><ul><li>Point one<li>Point two</ul>
<p hidden>Not shown</p><p>Another&nbsp;paragraph follows here, which goes on for quite a while; indeed it does.</p></article></div><form><p>Your name</p><button>Send</button></form>
<div class="comments"><p>Great post! I really enjoyed reading every single word of this story, thanks.</p></div><aside>See also</aside><footer>&copy; us</footer>"""
TEXT = "A title & more\n\nThis is the first paragraph of the story, with enough words to look like text.\n\nShort one.\n\nPoint one\n\nPoint two\n\nAnother paragraph follows here, which goes on for quite a while; indeed it does."


def test_main_text():
    assert main_text(PAGE) == TEXT and main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    assert main_text("<article><p>" + "word " * 50_000 + "</p></article>").count("word") == 50_000
    for broken in ("<", "<p", "<!--", "<script>x", "<a href='", "</", "<p class=\"x", "&#x110000;", "<title>x"):
        main_text(broken)


def test_pages(spark):
    import html
    import re

    source = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries()["op9_html"](spark, FOLDER).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id].html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "", "", "")], "page_id bigint, url string, html string, text string")
    assert sorted(r.n_chars for r in extract(df).collect()) == [0, 0, len(TEXT), len(TEXT)]
    assert extract(df.limit(0)).count() == 0


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 8)
        source, sink = ([rng.choice([0, 0, 1, 2.5, 4]) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.choice([0.5, 1, 2])) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(kept):
            return sum(source[k] for k in range(n) if not kept[k]) + sum(sink[k] for k in range(n) if kept[k]) + sum(w for i, j, w in edges if kept[i] != kept[j])

        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(source, sink, edges)) == pytest.approx(best)


def test_training_moves_the_weights():
    w = train([PAGE] * 3)
    found = blocks(PAGE)
    assert len(w) == 11 and any(b.says > 0 for b in found) and any(b.says < 0 for b in found)


# -- licenses


def test_licenses_in_texts(spark):
    s = Scanner()
    for name, text in TEMPLATES.items():
        got = s.scan(("Some words before.\n\n" + text.replace("{v}", "2.0").replace("{y}", "2020 Foo") + "\n\nand after.").encode())
        if name not in ("CC0-text", "Reserved"):
            assert [h[2] for h in got] == [name], name
    assert s.scan(b"My driving license expired; no warranty.") == [] == s.scan(None) == s.scan(b"")
    assert s.scan("Licensed under CC BY-NC 4.0.".encode())[0][2] == "CC-BY-NC-notice"
    hit = s.scan(TEMPLATES["MIT-text"].replace("free of charge", "free of any charge").encode())[0]
    assert hit[2] == "MIT-text" and hit[5] == "any"


def test_license_query(spark):
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = Counter(i for i, t in texts.items() for _ in re.findall(r"(?m)^(?:This work is licensed under the GNU|Licensed under CC|Released under the MIT|Licensed under the Apache)", t))
    rows = queries()["op7_licenses"](spark, "/root/testdata/sf0.01").collect()
    assert Counter(r.doc_id for r in rows) == want
    assert all(texts[r.doc_id].encode()[r.start : r.end].decode().startswith(("This", "Lic", "Rel")) for r in rows)


def test_license_odd_rows(docs, nothing):
    assert licenses(docs).count() == licenses(nothing).count() == 0


# -- decontamination


def test_bits_give_the_common_length():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        mask = {}
        for k, w in enumerate(b):
            mask[w] = mask.get(w, 0) | 1 << k
        assert D.common(a, mask, len(b)) == common_length(a, b)


def test_singular_vectors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 40))
    w = rng.normal(size=(40, 12))
    u = D.singular_vectors(w, a.T @ (a @ w))
    assert np.allclose(u @ (u.T @ a.T), a.T, atol=1e-2 * np.abs(a).max())


def test_planted_and_paraphrased(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    common = ["the", "of", "and", "to", "in"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n))
    items = [(k, ". ".join(prose(12) for _ in range(3)) + ".") for k in range(20)] + [(20, "too short"), (21, ""), (22, None)]
    rows = [(k, prose(300)) for k in range(200)]
    rows += [(1000 + k, prose(40) + " " + items[k][1].upper() + "\n" + prose(70)) for k in range(8)]
    for k in range(8, 14):  # a third of the words before the answer replaced
        *head, last = items[k][1].rstrip(".").split(". ")
        rows.append((1000 + k, prose(50) + " " + ". ".join(" ".join(w if j % 3 else "other" for j, w in enumerate(h.split())) for h in head) + ". " + last + ". " + prose(50)))
    rows += [(2000, items[0][1]), (2000, items[0][1]), (None, items[1][1]), (3000, None), (3001, ""), (3002, "it is too short for us")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect())
    assert got == Counter([(1000 + k, k) for k in range(14)] + [(2000, 0), (2000, 0), (None, 1), (3002, 20)])
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(200), 3000, 3001])
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0
    held, D.BLOCK_BYTES = D.BLOCK_BYTES, 600
    try:
        assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} >= {(1000 + k, k) for k in range(8)}
    finally:
        D.BLOCK_BYTES = held


def test_decontamination_query(spark):
    """Recall against all five-word runs of the benchmark."""
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    cut = lambda t: hashed_words([t.encode()])[0].tolist()
    runs, sizes = {}, {}
    for r in bench:
        w = cut(r.text)
        sizes[r.item_id] = len(w) - 4
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), set()).add(r.item_id)
    want = set()
    for r in docs:
        w, c = cut(r.text), Counter()
        for run in {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            c.update(runs.get(run, ()))
        want |= {(r.doc_id, i) for i, n in c.items() if n >= 0.7 * sizes[i]}
    got = {(r.doc_id, r.item_id) for r in queries()["op10_decontamination"](spark, folder).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want) + 2
