"""Behaviour of the index on small hand-made collections, for both storages."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata import IndexConfig, Quantizer, QueryBudget, SearchOptions, VectorIndex
from vecstrata.errors import BudgetExceededError, ConfigMismatchError, DimensionMismatchError, IndexClosedError, IndexExistsError, IndexNotFoundError, InvalidArgumentError, InvalidVectorError, ManifestConflictError, SnapshotExpiredError, StorageError
from vecstrata.functions.vectors import label_set
from vecstrata.index import recall, run_typed
from vecstrata.operators.graph import Graph
from vecstrata.streaming import ingest, mutation_stream

ROW = "external_id bigint, vector array<double>, labels array<smallint>"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], sorted(ls)) for i, v, ls in ((*r, ()) if len(r) == 2 else r for r in rows)], ROW)


def asked(spark, *vectors, wanted=None):
    q = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "query_id bigint, vector array<double>")
    return q if wanted is None else q.withColumn("filter", F.array(*[F.lit(x) for x in wanted]).cast("array<smallint>"))


def hits(df):
    return [(r.query_id, r.node_id, round(r.distance, 5)) for r in sorted(run_typed(df), key=lambda r: (r.query_id, r["rank"]))]


def nodes_of(df):
    return [n for _, n, _ in hits(df)]


@pytest.fixture
def uri(tmp_path, request):
    """A storage for each test; the two kinds take turns, so both see half of the scenarios."""
    kind = sum(map(ord, request.node.name)) % 2
    return f"file:{tmp_path}/index" if kind else f"memory:{uuid.uuid4().hex}"


def built(spark, uri, rows, **config):
    index = VectorIndex.create(spark, uri, IndexConfig(len(rows[0][1]), **config))
    index.bulk_build(table(spark, rows))
    return index


def test_basic_search(spark, uri):
    ix = built(spark, uri, [(101, [0, 0]), (102, [1, 0]), (103, [0, 1]), (104, [4, 4]), (105, [5, 4]), (106, [4, 5])])
    q = asked(spark, [0.9, 0.2])
    assert hits(ix.search(q, 3, 6)) == hits(ix.exact_search(q, 3)) and nodes_of(ix.search(q, 1, 6)) == [2]


def test_insert_and_old_snapshot(spark, uri):
    ix = built(spark, uri, [(401, [0, 0]), (402, [10, 0]), (403, [20, 0])], max_neighbors=2)
    old = ix.snapshot()
    ix.insert(table(spark, [(404, [11, 0])]))
    q = asked(spark, [11, 0])
    assert nodes_of(ix.search(q, 1, 4)) == [4] and nodes_of(ix.search(q, 1, 4, snapshot=old)) == [2]
    assert 4 in ix.nodes().where("node_id = 2").first().neighbors


def test_reopen_keeps_hot_rows(spark, tmp_path):
    uri = f"file:{tmp_path}/index"
    ix = built(spark, uri, [(901, [0, 0]), (902, [5, 0]), (903, [10, 0])])
    ix.insert(table(spark, [(904, [1, 0])]))
    ix.delete(spark.createDataFrame([(1,)], "node_id bigint"))
    ix.close()
    with pytest.raises(IndexClosedError):
        ix.snapshot()
    ix = VectorIndex.open(spark, uri)
    ix.insert(table(spark, [(905, [12, 0])]))
    q = asked(spark, [1, 0])
    assert sorted(r.node_id for r in ix.nodes().collect()) == [2, 3, 4, 5]
    assert hits(ix.search(q, 3, 5)) == hits(ix.exact_search(q, 3)) and nodes_of(ix.search(q, 1, 5)) == [4]
    ix.close()
    other = VectorIndex.create(spark, "memory:", IndexConfig(2))
    other.bulk_build(table(spark, [(901, [0, 0]), (902, [5, 0]), (903, [10, 0])]))
    with VectorIndex.open(spark, uri) as ix:
        other.replay(ix.mutations())
        other.replay(ix.mutations())  # applied before: nothing happens
        assert hits(other.search(q, 3, 5)) == hits(ix.search(q, 3, 5))


def test_reduced_dimensions_rescored(spark, uri):
    ix = built(spark, uri, [(701, [0, 100, 0]), (702, [0, 0, 0]), (703, [1, 0, 0])], routing_dimensions=1)
    q = asked(spark, [0, 0, 0])
    assert hits(ix.search(q, 2, 3)) == hits(ix.exact_search(q, 2)) and nodes_of(ix.search(q, 1, 3)) == [2]
    assert hits(ix.search(q, 2, 3, rescore=False))[0][2] == 0.0


def test_inner_product_and_cosine(spark, uri):
    ix = built(spark, uri, [(1001, [1, 0]), (1002, [0, 3]), (1003, [2, 1])], distance="inner_product")
    q = asked(spark, [0, 1])
    assert hits(ix.search(q, 2, 3)) == hits(ix.exact_search(q, 2)) == [(0, 2, -3.0), (0, 3, -1.0)]
    ix = built(spark, "memory:", [(1201, [50, 50]), (1202, [1, 0]), (1203, [0.4, 0.3]), (1204, [0, 2.5])], distance="cosine")
    q = asked(spark, [3, 0])
    got = hits(ix.search(q, 4, 4))
    assert got == hits(ix.exact_search(q, 4)) and got[0][1] == 2 and got[0][2] < got[1][2]


def test_quantized(spark, uri):
    rows = [(201, [-2, -2, 0]), (202, [-1, -1, 0.1]), (203, [1, 1, 9]), (204, [2, 2, 9.1])]
    ix = built(spark, uri, rows, quantizer=Quantizer(1, True))
    q = asked(spark, [1.1, 1.1, 9.2])
    assert hits(ix.search(q, 2, 4)) == hits(ix.exact_search(q, 2)) and ix.snapshot().manifest["quantizer"] is not None
    fresh = VectorIndex.create(spark, "memory:", IndexConfig(3, quantizer=Quantizer(1, True)))
    with pytest.raises(StorageError):
        fresh.insert(table(spark, rows[:1]))


def test_tombstones_and_reads(spark, uri):
    ix = built(spark, uri, [(501, [0, 0]), (502, [1, 0]), (503, [2, 0])])
    ix.delete(spark.createDataFrame([(502,)], "external_id bigint"))
    q = asked(spark, [1, 0])
    assert 2 not in nodes_of(ix.search(q, 2, 3)) and nodes_of(ix.search(q, 1, 3)) == [1]
    assert [r.status for r in ix.read_nodes([3, 2, 9, 3]).collect()] == ["Present", "Tombstoned", "Missing", "Present"]
    assert ix.read_full_vectors([3]).first().full_vector == [2.0, 0.0]
    with pytest.raises(InvalidArgumentError):
        ix.delete(spark.createDataFrame([(502,)], "external_id bigint"))
    with pytest.raises(BudgetExceededError):
        ix.read_nodes([1, 2], budget=QueryBudget(max_read_batch=1))


def test_label_filter(spark, uri):
    rows = [(601, [0, 0], {1}), (602, [1, 0], {2}), (603, [0.2, 0], {1, 3}), (604, [8, 0], {4})]
    ix = built(spark, uri, rows, has_labels=True)
    q = asked(spark, [0, 0])
    assert nodes_of(ix.search(q, 3, 4, filter=[3])) == [3]
    assert hits(ix.search(q, 3, 4, filter=[1])) == hits(ix.exact_search(q, 3, filter=[1]))
    assert hits(ix.search(q, 4, 4, filter=[])) == hits(ix.exact_search(q, 4))
    assert nodes_of(ix.search(asked(spark, [0, 0], wanted=[4]), 3, 4)) == [4]
    assert ix.snapshot().manifest["starts"]["0"] == {"default": 1, "labeled": {"1": 1, "2": 2, "3": 3, "4": 4}}


def test_few_neighbors_still_reach_all(spark, uri):
    ix = built(spark, uri, [(800 + k, [k, 0]) for k in range(8)], max_neighbors=1, build_search_list_size=8)
    q = asked(spark, [7, 0])
    assert nodes_of(ix.search(q, 1, 8, budget=QueryBudget(max_read_batch=1, max_visited=8, max_candidates=8))) == [8]
    assert ix.reachable().count() == 8 and {r.violations for r in ix.invariants().collect()} == {0}


def test_all_together(spark, uri):
    rows = [(1101, [-2, -2, 0], {1}), (1102, [-1, -1, 0.2], {1, 2}), (1103, [1, 1, 8], {2}), (1104, [2, 2, 8.5], {3}), (1105, [1.2, 1.1, 7.8], {2, 3})]
    ix = built(spark, uri, rows, max_neighbors=4, build_search_list_size=8, has_labels=True, quantizer=Quantizer(1, True))
    ix.delete(spark.createDataFrame([(3,)], "node_id bigint"))
    ix.insert(table(spark, [(1106, [1.05, 1.05, 8.1], {2})]))
    q = asked(spark, [1, 1, 8])
    got = hits(ix.search(q, 3, 8, filter=[2]))
    assert got[0][1] == 6 and got == hits(ix.exact_search(q, 3, filter=[2])) and 3 not in [n for _, n, _ in got]


def test_high_water_and_start_repair(spark, uri):
    ix = built(spark, uri, [(1301, [0, 0])])
    ix.delete(spark.createDataFrame([(1,)], "node_id bigint"))
    assert ix.snapshot().manifest["max_node"] == 1 and ix.nodes().count() == 0
    ix.insert(table(spark, [(1302, [1, 0])]))
    assert [r.node_id for r in ix.nodes().collect()] == [2] and nodes_of(ix.search(asked(spark, [1, 0]), 1, 1)) == [2]
    labelled = built(spark, "memory:", [(1, [0, 0], {1}), (2, [1, 0], {1}), (3, [10, 0], {2}), (4, [11, 0], {2})], has_labels=True)
    labelled.delete(spark.createDataFrame([(1,)], "node_id bigint"))
    assert labelled.snapshot().manifest["starts"]["0"] == {"default": 3, "labeled": {"1": 2, "2": 3}}


def test_budgets(spark):
    ix = built(spark, "memory:", [(241, [0, 0]), (242, [1, 0]), (243, [2, 0])])
    q = asked(spark, [0, 0])
    for name, most in (("max_query_bytes", 1), ("max_rescore", 1), ("max_full_vector_bytes", 7), ("max_visited", 1), ("max_candidates", 1)):
        with pytest.raises(BudgetExceededError):
            run_typed(ix.search(q, 2, 3, budget=QueryBudget(**{name: most})))
    assert len(run_typed(ix.search(q, 2, 3, budget=QueryBudget(max_visited=3, max_candidates=3, max_read_batch=1, max_rescore=3, max_full_vector_bytes=24, max_query_bytes=4096)))) == 2


def test_input_errors(spark):
    ix = built(spark, "memory:", [(1, [0, 0]), (2, [1, 0])])
    for rows, error in (([(3, [1])], DimensionMismatchError), ([(3, [1, float("nan")])], InvalidVectorError), ([(3, [0, 0], {1})], InvalidArgumentError), ([(3, [0, 0]), (3, [1, 1])], InvalidArgumentError), ([(2, [5, 5])], InvalidArgumentError)):
        with pytest.raises(error):
            ix.insert(table(spark, rows))
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(InvalidVectorError):
            ix.search(asked(spark, [bad, 0]), 1, 1)
    with pytest.raises(DimensionMismatchError):
        ix.search(asked(spark, [1.0]), 1, 1)
    for bad in (dict(limit=0, search_list_size=1), dict(limit=2, search_list_size=1), dict(limit=1, search_list_size=1, filter=(1 << 15,))):
        with pytest.raises(InvalidArgumentError):
            SearchOptions(**bad)
    for bad in (dict(dimensions=0), dict(dimensions=2, routing_dimensions=3), dict(dimensions=2, distance="x"), dict(dimensions=2, max_alpha=0.9), dict(dimensions=2, max_neighbors=0)):
        with pytest.raises(InvalidArgumentError):
            IndexConfig(**bad)
    with pytest.raises(InvalidArgumentError):
        QueryBudget(max_visited=0)


def test_handles(spark, uri, tmp_path):
    with pytest.raises(IndexNotFoundError):
        VectorIndex.open(spark, uri)
    ix = VectorIndex.open_or_create(spark, uri, IndexConfig(2))
    with pytest.raises(IndexExistsError):
        VectorIndex.create(spark, uri, IndexConfig(2))
    with pytest.raises(StorageError):
        VectorIndex.open(spark, uri)
    ix.close()
    with pytest.raises(ConfigMismatchError):
        VectorIndex.open(spark, uri, IndexConfig(3))
    ix = VectorIndex.open_or_create(spark, uri, IndexConfig(2))
    with pytest.raises(InvalidArgumentError):
        ix.search(asked(spark, [0, 0]), 1, 1, snapshot=VectorIndex.create(spark, "memory:", IndexConfig(2)).snapshot())
    with pytest.raises(ManifestConflictError):
        ix.storage.publish(ix.storage.latest(), 0)
    ix.close()
    if uri.startswith("file:"):
        (tmp_path / "index" / "stranger").write_text("x")
        with pytest.raises(StorageError):
            VectorIndex.destroy(spark, uri)
        (tmp_path / "index" / "stranger").unlink()
        ix = VectorIndex.open_or_create(spark, uri, IndexConfig(2)) if VectorIndex.exists(spark, uri) and not (tmp_path / "index" / "LOCK").exists() else None
        if ix:
            ix.close()
        (tmp_path / "index" / "LOCK").unlink(missing_ok=True)
    VectorIndex.destroy(spark, uri)
    assert not VectorIndex.exists(spark, uri)


def test_log_and_retention(spark, uri):
    ix = built(spark, uri, [(1, [0, 0])])
    first = ix.insert(table(spark, [(2, [1, 0])]))
    ix.insert(table(spark, [(3, [2, 0])]))
    ix.delete(spark.createDataFrame([(2,)], "node_id bigint"))
    assert [(r.log_offset, r.op, r.node_id) for r in ix.mutations().orderBy("log_offset").collect()] == [(0, "insert", 2), (1, "insert", 3), (2, "delete", 2)]
    ix.checkpoint(1)
    ix.truncate_before_checkpoint()
    assert ix.checkpoint_offset() == 1 and [r.log_offset for r in ix.mutations(1).orderBy("log_offset").collect()] == [1, 2]
    with pytest.raises(StorageError):
        ix.mutations(0)
    with pytest.raises(InvalidArgumentError):
        ix.checkpoint(9)
    ix.vacuum(retain=1)
    with pytest.raises(SnapshotExpiredError):
        ix.nodes(first).count()
    assert ix.nodes().count() == 2
    assert ix.bulk_build(table(spark, [])).manifest["segments"] == [] and ix.nodes().count() == 0


def test_cache_and_recovery(spark):
    ix = built(spark, "memory:", [(k, [k, 0]) for k in range(6)], max_neighbors=2, build_search_list_size=4, shards=2)
    ix.cache(1)
    q = asked(spark, [2.2, 0])
    before = ix.snapshot()
    assert hits(ix.search(q, 3, 6)) == hits(ix.exact_search(q, 3)) and list(ix._cached) == [before.version]
    ix.insert(table(spark, [(9, [2.1, 0])]))
    ix.delete(spark.createDataFrame([(7,)], "node_id bigint"))
    assert hits(ix.search(q, 3, 7)) == hits(ix.exact_search(q, 3)) and list(ix._cached) == [ix.snapshot().version]
    assert nodes_of(ix.search(q, 1, 7, snapshot=before)) == [3] and ix.recovered_high_water() == 7
    assert recall(ix.search(q, 3, 7), ix.exact_search(q, 3), 3) == 1.0
    ix.close()
    assert not ix._cached


def test_stream(spark, tmp_path):
    source = built(spark, "memory:", [(1, [0, 0])])
    source.insert(table(spark, [(2, [1, 0]), (3, [2, 0])]))
    source.delete(spark.createDataFrame([(2,)], "node_id bigint"))
    target = built(spark, "memory:", [(1, [0, 0])])
    source.mutations().coalesce(1).write.parquet(f"{tmp_path}/log")
    for _ in range(2):
        ingest(target, mutation_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.node_id for r in target.nodes().collect()) == [1, 3]


def walk_all(n, d, seed, **config):
    rng = np.random.default_rng(seed)
    full = rng.normal(size=(n, d))
    labels = [frozenset() for _ in range(n)]
    g = Graph(IndexConfig(d, **config), np.arange(1, n + 1), np.arange(n), full, full, labels)
    g.build()
    g.neighbors = [[int(g.ids[k]) for k in x] for x in g.neighbors]
    return g


def test_graph_is_deterministic_and_whole():
    a, b = (walk_all(80, 8, 1, max_neighbors=4, build_search_list_size=16) for _ in range(2))
    assert a.neighbors == b.neighbors and max(map(len, a.neighbors)) <= 4
    assert len(a.breadth_first([1], 1000)[0]) == 80 and a.breadth_first([1], 3)[1]
    q = np.zeros(8)
    assert [k for _, k in a.search(q, q, [1], 10, 80)] == np.lexsort((np.arange(80), (a.full**2).sum(1)))[:10].tolist()


def test_equal_vectors_are_all_found():
    full = np.ones((12, 2))
    g = Graph(IndexConfig(2, max_neighbors=2, build_search_list_size=4), np.arange(1, 13), np.arange(12), full, full, [frozenset()] * 12)
    g.build()
    g.neighbors = [[int(g.ids[k]) for k in x] for x in g.neighbors]
    assert len(g.search(full[0], full[0], [1], 12, 12)) == 12


def test_recall_of_short_walks():
    g = walk_all(1000, 16, 3, max_neighbors=24, build_search_list_size=64)
    rng, good = np.random.default_rng(9), 0
    for q in rng.normal(size=(30, 16)):
        true = set(np.argsort(((g.full - q) ** 2).sum(1))[:10].tolist())
        good += len(true & {k for _, k in g.search(q, q, [1], 10, 64)})
    assert good / 300 >= 0.95


def test_label_set_column(spark):
    assert spark.range(1).select(label_set(F.array(F.lit(2), F.lit(1), F.lit(2)))).first()[0] == [1, 2]
