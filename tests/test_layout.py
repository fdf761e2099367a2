"""Segments laid out by shard, and chains of change sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vecstrata import IndexConfig, SearchOptions, VectorIndex
from vecstrata.operators.shards import walk
from vecstrata.plans.visibility import merged_changes, visible_nodes

ROWS = "external_id bigint, vector array<double>"


def rows(spark, ids):
    rng = random.Random(2)
    at = {k: [rng.random() for _ in range(4)] for k in range(400)}
    return spark.createDataFrame([(k, at[k]) for k in ids], ROWS)


def shuffled(df, table):
    """The shuffles of a plan, after it has run, that move rows of a table: what stands below has its name."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    deep = [len(x) - len(x.lstrip(" +-:")) for x in lines]
    found = []
    for k, x in enumerate(lines):
        if re.search(r"\bExchange (?:hash|range|Single|Round)", x):
            end = next((j for j in range(k + 1, len(lines)) if deep[j] <= deep[k]), len(lines))
            if any(table in y for y in lines[k:end]) and not any("InMemoryRelation" in y for y in lines[:k] if deep[lines.index(y)] < deep[k]):
                found.append(x.strip(" +-:"))
    return found


def seen(index, snapshot=None):
    return {r.node_id: (r.external_id, tuple(r.full_vector), tuple(r.neighbors)) for r in index.nodes(snapshot).collect()}


@pytest.fixture(params=["file", "memory"])
def index(spark, request, tmp_path):
    uri = f"file:{tmp_path}/index it's" if request.param == "file" else "memory:"
    ix = VectorIndex.create(spark, uri, IndexConfig(4, shards=5, max_neighbors=6, build_search_list_size=12))
    ix.bulk_build(rows(spark, range(200)))
    yield ix
    ix.close()


def test_a_walk_shuffles_no_node_rows(spark, index):
    """Rows of segments are read where they lie, also under change sets; hits are shuffled to be ranked."""
    q = rows(spark, range(0, 200, 20)).select(F.col("external_id").alias("query_id"), "vector")
    options, filed = SearchOptions(5, 60), index.storage.uid.startswith("file")
    below = lambda: index.nodes().groupBy("shard").applyInArrow(lambda key, t: t.select(["node_id"]), "node_id bigint")
    assert shuffled(below(), "/segments/" if filed else "Scan") == []
    for change in (lambda: index.insert(rows(spark, range(200, 220))), lambda: index.delete(rows(spark, [3, 210]).select("external_id"))):
        change()
        if filed:
            assert shuffled(below(), "/segments/") == []
        hits = walk(index.nodes(), q, index.config, index.snapshot().manifest["starts"], None, options)
        assert {(r.query_id, r.id) for r in hits.collect()} == {(r.query_id, r.node_id) for r in index.exact_search(q, 5).collect()}


def test_change_sets_are_as_large_as_the_change(spark, index):
    index.insert(rows(spark, range(200, 210)))
    index.insert(rows(spark, [300]))
    index.delete(rows(spark, [5, 205]).select("external_id"))
    sets = index.snapshot().manifest["changes"]
    most = index.config.max_neighbors
    assert [c["count"] <= n * (1 + most) for c, n in zip(sets, (10, 1, 2), strict=True)] == [True] * 3 and sets[2]["count"] == 2


def test_compaction_changes_nothing_that_is_seen(spark, index):
    first = index.insert(rows(spark, range(200, 210)))
    at_first = seen(index)
    index.insert(rows(spark, range(210, 215)))
    index.delete(rows(spark, [5, 205]).select("external_id"))
    index.insert(rows(spark, [300]))
    before, reads = seen(index), index.read_nodes([1, 6, 206, 207, 999]).collect()
    assert len(before) == 200 + 16 - 2 and seen(index, first) == at_first
    index.compact()
    assert len(index.snapshot().manifest["changes"]) == 1
    assert seen(index) == before and index.read_nodes([1, 6, 206, 207, 999]).collect() == reads and seen(index, first) == at_first
    assert index.recovered_high_water() == index.snapshot().manifest["max_node"] == 216
    index.insert(rows(spark, [301]))
    assert len(seen(index)) == len(before) + 1
    assert index.compact().manifest["changes"][0]["count"] > 0


def test_reopened_tables_keep_their_layout(spark, tmp_path):
    uri = f"file:{tmp_path}/index"
    with VectorIndex.create(spark, uri, IndexConfig(4, shards=3, max_neighbors=4)) as ix:
        ix.bulk_build(rows(spark, range(60)))
        ix.insert(rows(spark, [70]))
        before = seen(ix)
    for t in spark.catalog.listTables():
        if t.name.startswith("vecstrata_"):
            spark.sql(f"drop table {t.name}")  # as in a new session, whose catalog is empty
    with VectorIndex.open(spark, uri) as ix:
        assert seen(ix) == before
        assert shuffled(ix.nodes().groupBy("shard").applyInArrow(lambda key, t: t.select(["node_id"]), "node_id bigint"), "/segments/") == []
        assert len(list((tmp_path / "index/segments/1").glob("part-*"))) <= 3
    VectorIndex.destroy(spark, uri)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vecstrata_")]


def test_later_sets_win(spark):
    base = spark.createDataFrame([(k, k * 10, [k + 1]) for k in range(1, 7)], "node_id bigint, external_id bigint, neighbors array<bigint>")
    sets = [
        (2, 20, [9], "rewrite", None, 0), (7, 70, [1], "record", None, 0), (3, None, [1, 2], "rewrite", None, 0),
        (2, None, [5, 6], "rewrite", None, 1), (7, None, [2, 3], "rewrite", None, 1), (4, None, None, "tombstone", 1, 1),
        (7, None, None, "tombstone", 2, 2), (8, 80, [], "record", None, 2), (3, None, [], "rewrite", None, 2),
    ]
    changes = spark.createDataFrame(sets, "node_id bigint, external_id bigint, neighbors array<bigint>, kind string, epoch bigint, set_pos int")
    got = {r.node_id: (r.external_id, r.neighbors) for r in visible_nodes(base, *merged_changes(changes), 1).collect()}
    assert got == {1: (10, [2]), 2: (20, [5, 6]), 3: (30, []), 5: (50, [6]), 6: (60, [7]), 7: (70, [2, 3]), 8: (80, [])}
    assert 7 not in {r.node_id for r in visible_nodes(base, *merged_changes(changes), 2, few=True).collect()}
