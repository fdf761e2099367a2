"""Replaying a log: the same state as the calls that wrote it, its rules, and its plan."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from vecstrata import IndexConfig, VectorIndex
from vecstrata.errors import DimensionMismatchError, InvalidArgumentError
from vecstrata.plans.numbering import runs

LOG = "log_offset bigint, op string, node_id bigint, external_id bigint, full_vector array<float>, labels array<smallint>"


@contextmanager
def confs(spark, values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rows(spark, ids):
    rng = random.Random(4)
    at = {k: ([rng.random() for _ in range(3)], rng.sample([1, 2, 3], rng.randrange(3))) for k in range(200)}
    return spark.createDataFrame([(k, *at[k]) for k in ids], "external_id bigint, vector array<float>, labels array<smallint>")


def state(index):
    nodes = {r.node_id: (r.external_id, tuple(r.full_vector), tuple(r.labels), tuple(r.neighbors)) for r in index.nodes().collect()}
    m = index.snapshot().manifest
    dead = {(r.node_id, r.epoch) for r in index._delta(m, "tombstones").collect()}
    return nodes, m["starts"], dead, {k: m[k] for k in ("epoch", "max_node", "applied")}


def test_a_log_gives_what_its_calls_gave(spark):
    """Inserts and deletes in turn, entry nodes among the deleted, an id that comes back, a shard that empties."""
    config = IndexConfig(3, shards=3, max_neighbors=4, build_search_list_size=8, has_labels=True)
    with VectorIndex.create(spark, "memory:", config) as ix, VectorIndex.create(spark, "memory:", config) as other:
        for op, ids in [("insert", range(12)), ("delete", [0, 1, 3]), ("insert", [20, 0]), ("delete", [5, 6, 9, 20]), ("insert", [30]), ("insert", [31, 32])]:
            ix.insert(rows(spark, ids)) if op == "insert" else ix.delete(rows(spark, ids).select("external_id"))
        log = ix.mutations()
        other.replay(log.where("log_offset < 13"))  # a batch may end within a run
        other.replay(log)
        before = other.replay(log)
        one, two = state(ix), state(other)
        assert one[0] == two[0] and one[1] == two[1] and {n for n, _ in one[2]} == {n for n, _ in two[2]}
        assert one[3]["max_node"] == two[3]["max_node"] and one[3]["applied"] == two[3]["applied"] and before.version == other.snapshot().version
        assert len(before.manifest["changes"]) == 2
    with VectorIndex.create(spark, "memory:", config) as third:
        third.replay(log)  # cut between runs alone: the epochs are the same too
        assert state(third)[:4] == one


def vectors(*steps):
    return [(k, op, n, x, [float(n or 0), 1.0] if op == "insert" else None, []) for k, (op, n, x) in enumerate(steps)]


@pytest.mark.parametrize(
    "steps, stay",
    [
        ([("insert", 1, 10), ("delete", 2, 11)], {1}),  # never there
        ([("insert", 1, 10), ("delete", 1, 10), ("insert", 3, 12), ("delete", 1, 10)], {3}),  # gone already
        ([("insert", 1, 10), ("delete", 1, 10), ("insert", 1, 11)], set()),  # a node id is not given out twice
        ([("insert", 1, 10), ("delete", 1, 10), ("insert", 2, 10), ("insert", 3, 10)], set()),  # taken again in the same run
        ([("insert", 1, 10), ("drop", 1, 10)], {1}),
        ([("insert", 1, 10), (None, 1, 10)], {1}),
        ([("delete", 1, 10), ("insert", 1, 10)], set()),
        ([("insert", 1, 10), ("delete", None, 10)], {1}),
    ],
)
def test_the_runs_before_a_fault_stay(spark, steps, stay):
    with VectorIndex.create(spark, "memory:", IndexConfig(2, shards=2)) as ix:
        with pytest.raises(InvalidArgumentError):
            ix.replay(spark.createDataFrame(vectors(*steps), LOG))
        assert {r.node_id for r in ix.nodes().collect()} == stay


def test_a_log_is_held_to_what_the_index_has(spark):
    with VectorIndex.create(spark, "memory:", IndexConfig(2, shards=2)) as ix:
        ix.replay(spark.createDataFrame(vectors(("insert", 1, 10), ("insert", 2, 11), ("delete", 2, 11)), LOG))
        later = lambda *steps: spark.createDataFrame([(k + 3, *r) for k, *r in vectors(*steps)], LOG)
        for steps in ([("insert", 3, 10)], [("insert", 2, 12)], [("delete", 2, 11)], [("insert", 1, 12)]):
            with pytest.raises(InvalidArgumentError):
                ix.replay(later(*steps))
        with pytest.raises(DimensionMismatchError):
            ix.replay(spark.createDataFrame([(3, "insert", 4, 40, [1.0], None)], LOG))
        assert {r.node_id for r in ix.nodes().collect()} == {1}
        ix.replay(later(("delete", 1, 10), ("insert", 3, 10), ("insert", 4, 11)))  # both external ids are free when they come
        assert {(r.node_id, r.external_id) for r in ix.nodes().collect()} == {(3, 10), (4, 11)}
        version = ix.snapshot().version
        assert ix.replay(later().limit(0)).version == version


@pytest.mark.parametrize("size", [0, 1, 500])
def test_runs_are_cut_without_a_task_that_sees_all(spark, size):
    rng = random.Random(size)
    made = [(k * 3, rng.choice(["a", "a", "a", "b", None])) for k in range(size)]
    want, at = [], 0
    for k, (o, v) in enumerate(made):
        at += k > 0 and v != made[k - 1][1]
        want.append((o, v, at))
    with confs(spark, {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = runs(spark.createDataFrame(made, "o bigint, v string").repartition(7), ["o"], "v").persist()
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        assert size < 500 or got.select(F.spark_partition_id()).distinct().count() > 1
