"""LM scores against plain dictionary models, whatever the number of batches and slots."""

import pytest
from test_others import plain_loss

from vecstrata.llm import lm_score
from vecstrata.llm.lm_score import packed, score, unpacked

np = lm_score.np


def compare(rows, chosen, docs, targets):
    """All rows of ``rows(doc_id, text)``: number of tokens and both losses."""
    texts = [t for _, t in rows]
    want = {}
    for (i, _), x in zip(rows, plain_loss(texts, [i in chosen for i, _ in rows], texts), strict=True):
        want.setdefault(i, []).append(x)
    got = {}
    for r in score(docs, targets).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    for i in want:
        for (n, loss), r in zip(sorted(want[i], key=str), sorted(got[i], key=lambda r: str((r.n_tokens, r.target_loss and [r.target_loss]))), strict=True):
            assert r.n_tokens == n and (r.score is None) == (loss is None)
            if loss:
                assert r.target_loss == pytest.approx(loss[0], abs=1e-9) and r.background_loss == pytest.approx(loss[1], abs=1e-9)
                assert r.score == pytest.approx(loss[0] - loss[1], abs=1e-9)


def test_scores_are_those_of_exact_counts(spark, tmp_path, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 31 + j * j) % 4001}" for j in range(300))) for k in range(100)] + [(None, "w1 w2"), (1000, None), (7, "w7 w7"), (1001, "w1 " * 30_000)]
    chosen = set(range(0, 100, 7))
    targets = spark.createDataFrame([(k,) for k in chosen] + [(0,), (None,), (5000,)], "doc_id bigint")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    compare(rows, chosen, docs, targets)
    docs.write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(lm_score, "BATCH", 1 << 14)
    monkeypatch.setattr(lm_score, "LEAST_BATCH", 1 << 12)
    monkeypatch.setattr(lm_score, "LEAST_SLOTS", 300)
    compare(rows, chosen, spark.read.parquet(f"{tmp_path}/docs"), targets)
    monkeypatch.setattr(lm_score, "TARGETS", 2)
    compare(rows, chosen, spark.read.parquet(f"{tmp_path}/docs"), targets)


def test_targets_joined_by_a_shuffle_over_many_partitions(spark, tmp_path, monkeypatch):
    """Without adaptive coalescing the merge join deals a batch over partitions; its rows must come together again."""
    rows = [(k, " ".join(f"w{(k * 17 + j * j) % 301}" for j in range(200))) for k in range(300)]
    chosen = set(range(0, 300, 3))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    targets = spark.createDataFrame([(k,) for k in chosen], "doc_id bigint")
    monkeypatch.setattr(lm_score, "TARGETS", 1)
    monkeypatch.setattr(lm_score, "BATCH", 1 << 15)
    monkeypatch.setattr(lm_score, "LEAST_BATCH", 1 << 13)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        compare(rows, chosen, spark.read.parquet(f"{tmp_path}/docs"), targets)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    compare([tuple(r) for r in docs.collect()], {r.doc_id for r in good.collect()}, docs, good)


def test_numbers_are_packed_and_unpacked():
    for x in ([0], [], [1, 255, 256], [1 << 63, 0, 5]):
        x = np.array(x, np.uint64)
        assert (unpacked(packed(x), len(x)) == x).all()
