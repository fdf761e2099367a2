"""The pipeline against plain versions of its stages."""

import numpy as np
from brute import normal
from test_similar import kept as apart
from tokenizers import Tokenizer

import corpus_pipeline
from vecstrata.llm.queries import word_vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, FOLDER)
        assert k == 4 or made.columns == columns
        made.write.parquet(f"{tmp_path}/{k}")
        seen.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect()))
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen[0][1]}
    assert sum((i in kept) == bool(q) for i, q in truth.items()) >= 0.95 * len(truth)
    least = {}
    for r in seen[1][0]:
        least[normal(r.text)] = min(r.doc_id, least.get(normal(r.text), r.doc_id))
    assert {r.doc_id for r in seen[1][1]} == set(least.values())
    assert {r.doc_id for r in seen[2][1]} == apart([(r.doc_id, r.text) for r in seen[2][0]])  # five words, similarity of 0.8
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r.doc_id for r in seen[3][0] if any(b in " ".join(r.text.split()) for b in bench)}
    gone = {r.doc_id for r in seen[3][0]} - {r.doc_id for r in seen[3][1]}
    assert held <= gone and len(gone) <= len(held) + 3
    library = Tokenizer.from_file(word_vocabulary())
    texts = {r.doc_id: r.text for r in seen[4][0]}
    assert len(seen[4][1]) == len(texts)
    for r in seen[4][1]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, FOLDER).count() == len(texts)
