"""Quantizers by scope and version, and the shape checks of an index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata import IndexConfig, Quantizer, VectorIndex
from vecstrata.errors import StorageError
from vecstrata.functions.quantize import encode_matrix
from vecstrata.plans.registry import REGISTRY, latest, ones_by_scope, registered, train_scopes


def rows(spark, n=90):
    rng = random.Random(1)
    data = [(k, f"s{k % 3}", [rng.gauss(k % 3, 1 + k % 3) for _ in range(5)]) for k in range(n)]
    return spark.createDataFrame(data, "id bigint, scope string, vector array<double>"), data


def test_versions_count_up_by_scope_and_the_latest_counts(spark):
    df, _ = rows(spark)
    none = spark.createDataFrame([], REGISTRY)
    assert latest(none).collect() == []
    one = registered(none, train_scopes(df.where("scope <> 's2'")), Quantizer(2), 1)
    two = registered(one, train_scopes(df.where("scope = 's0' and id < 45")), Quantizer(1), 2)
    assert sorted((r.scope, r.version, r.ref) for r in two.collect()) == [("s0", 1, 1), ("s0", 2, 2), ("s1", 1, 1)]
    assert sorted((r.scope, r.version, r["count"], r.bits_per_dimension) for r in latest(two).collect()) == [("s0", 2, 15, 1), ("s1", 1, 30, 2)]


@pytest.mark.parametrize(("bits", "use_mean"), [(1, True), (2, True), (3, True), (1, False)])
def test_rows_are_encoded_by_their_own_scope(spark, bits, use_mean):
    df, data = rows(spark)
    registry = registered(spark.createDataFrame([], REGISTRY), train_scopes(df.where("scope <> 's2'")), Quantizer(bits, use_mean), 1)
    got = {r.id: r.ones for r in ones_by_scope(df, registry).collect()}
    for scope in ("s0", "s1"):
        mine = [(i, v) for i, s, v in data if s == scope]
        x = np.array([v for _, v in mine])
        words = encode_matrix(x, bits, use_mean, len(x), x.mean(0), x.var(0) * len(x))
        flags = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : 5 * bits].reshape(len(x), 5, bits)
        for (i, _), want in zip(mine, flags.sum(2).tolist(), strict=True):
            assert got[i] == want
    assert all(got[i] is None for i, s, _ in data if s == "s2")


def test_index_counts_its_trainings_and_checks_what_it_loads(spark, tmp_path):
    uri, config = f"file:{tmp_path}/index", IndexConfig(5, quantizer=Quantizer(2, True), shards=2)
    df = rows(spark)[0].select(F.col("id").alias("external_id"), "vector")
    with VectorIndex.create(spark, uri, config) as ix:
        ix.bulk_build(df)
        ix.bulk_build(df.where("external_id < 50"))
        assert sorted((r.scope, r.version, r["count"]) for r in ix.quantizers().collect()) == [("index", 1, 90), ("index", 2, 50)]
        ref = ix.snapshot().manifest["quantizer"]
        good = ix.quantizers().where(F.col("ref") == ref).collect()
    q = df.limit(1).select(F.col("external_id").alias("query_id"), "vector")
    for wrong in ({"dimensions": 4}, {"bits_per_dimension": 1}, {"use_mean": False}, {"mean": [0.0]}, {"m2": []}, {"count": 0}):
        with VectorIndex.open(spark, uri) as ix:
            ix.storage.put(f"quantizers/{ref}", spark.createDataFrame([tuple((good[0].asDict() | wrong).values())], REGISTRY))
            with pytest.raises(StorageError):
                ix.search(q, 1, 5)
