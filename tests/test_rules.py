"""Rules of the log, of storage and of distances, each against a plain version or an error."""

import json
import os

import numpy as np
import pytest

from vecstrata import IndexConfig, VectorIndex
from vecstrata.config import QueryBudget
from vecstrata.errors import DimensionMismatchError, InvalidArgumentError, InvalidVectorError, StorageError
from vecstrata.functions.quantize import code_bytes
from vecstrata.index import LOG
from vecstrata.operators.graph import Graph
from vecstrata.plans import exact_topk


def graph(seed, n=120, labels=False, most=8):
    rng = np.random.default_rng(seed)
    config = IndexConfig(6, max_neighbors=most, build_search_list_size=20, has_labels=labels)
    held = [frozenset(rng.integers(0, 5, rng.integers(0, 4)).tolist()) if labels else frozenset() for _ in range(n)]
    v = rng.normal(size=(n, 6)).astype(np.float32).astype(float)
    return Graph(config, np.arange(1, n + 1), np.arange(n), v, v, held, [[] for _ in range(n)])


def plain_prune(g, base, rows, most):
    """The rule by lists and single distances."""
    d = lambda a, b: float(((g.routing[a] - g.routing[b]) ** 2).sum())
    queue = sorted((d(base, r), r) for r in set(rows))
    if len(queue) <= most:
        return [r for _, r in queue]
    worst, out, alpha = {r: 0.0 for _, r in queue}, [], 1.0
    while alpha <= g.config.max_alpha and len(out) < most:
        for dist, r in queue:
            if len(out) < most and r not in out and worst[r] <= alpha:
                out.append(r)
                for far, other in queue:
                    if (far, other) > (dist, r) and other not in out:
                        if g.labels[base] and not (g.labels[r] & g.labels[other]) <= g.labels[base]:
                            continue
                        worst[other] = max(worst[other], far / d(r, other))
        alpha *= 1.2
    return (out + [r for _, r in queue if r not in out])[:most]


@pytest.mark.parametrize("labels", [False, True])
def test_pruning_matches_a_plain_version(labels):
    g = graph(3, labels=labels)
    for base in range(0, 120, 5):
        rows = np.array([r for r in range(120) if r != base and (r * 7 + base) % 3] * 2)
        assert g.prune(base, rows, g.between(base, rows), 8) == plain_prune(g, base, rows.tolist(), 8)


def test_a_needed_neighbour_takes_the_last_place():
    g = graph(1, n=5, most=2)
    g.neighbors = [[2, 1], [0], [], [], []]
    for k, other in ((0, 4), (0, 2), (1, 1), (2, 3)):
        g.ensure(k, other)
    assert g.neighbors[:3] == [[2, 4], [0], [3]]


@pytest.mark.parametrize("width", [5, 30, 200])
def test_walks_together_are_single_walks(width):
    g = graph(7)
    g.build()
    g.neighbors = [[int(g.ids[x]) for x in near] + [9999] for near in g.neighbors]  # a node that is not visible
    asked = np.random.default_rng(8).normal(size=(17, 6))
    starts = [[1], [1, 5], [9999], []] * 4 + [[3]]
    rows, dist = g.walk_all(asked, starts, width)
    for k, q in enumerate(asked):
        want = g.walk(q, starts[k], width, QueryBudget())
        assert [x for x in rows[k].tolist() if x >= 0] == [r for _, r in want]
        assert dist[k][rows[k] >= 0] == pytest.approx([d for d, _ in want])
    hits = g.search_all(asked, asked, starts, 4, width, [frozenset()] * 17)
    for k, q in enumerate(asked):
        assert [r for _, r in hits[k]] == [r for _, r in g.search(q, q, starts[k], 4, width)]


def test_distances_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    v = 1e3 + np.cumsum(rng.normal(size=(300, 16)), 0) * 1e-4
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = exact_topk(df, df, 5).collect()
    for q in range(0, 300, 13):
        d = ((v[q] - v) ** 2).sum(1)
        want = sorted(zip(d.tolist(), range(300), strict=True))[:5]
        mine = sorted((r.rank, r.id, r.distance) for r in got if r.query_id == q)
        assert [x[1] for x in mine] == [i for _, i in want] and [x[2] for x in mine] == pytest.approx([x for x, _ in want], rel=1e-9, abs=1e-18)


def test_null_vectors_ties_and_filters(spark):
    rows = [(1, [0.0, 0.0], [1]), (2, [0.0, 0.0], [2, 3]), (3, None, [1]), (4, [1.0, 0.0], None), (None, [0.0, 0.0], [1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, labels array<smallint>")
    asked = spark.createDataFrame([(10, [0.0, 0.0], [3]), (11, [0.0, 0.0], []), (12, None, [1]), (13, [0.0, 0.0], [9])], "vec_id bigint, embedding array<double>, wanted array<smallint>")
    got = sorted((r.query_id, r.rank, r.id) for r in exact_topk(df, asked, 2, labels_col="labels", filter_col="wanted").collect())
    assert got == [(10, 1, 2), (11, 1, 1), (11, 2, 2)]
    assert exact_topk(df, asked.limit(0), 2).count() == 0


def log(spark, rows):
    return spark.createDataFrame([(k, "insert", n, x, v, labels) for k, (n, x, v, labels) in enumerate(rows)], LOG)


@pytest.mark.parametrize(
    "rows, error",
    [
        ([(1, 10, [1.0], [])], DimensionMismatchError),
        ([(1, 10, [float("nan"), 0.0], [])], InvalidVectorError),
        ([(1, 10, [1.0, 0.0], [5])], InvalidArgumentError),
        ([(1, 10, [1.0, 0.0], []), (2, 10, [0.0, 1.0], [])], InvalidArgumentError),
        ([(1, 10, [1.0, 0.0], []), (1, 11, [0.0, 1.0], [])], InvalidArgumentError),
        ([(None, 10, [1.0, 0.0], [])], InvalidArgumentError),
    ],
)
def test_replay_refuses_what_insert_refuses(spark, rows, error):
    with VectorIndex.create(spark, "memory:", IndexConfig(2, distance="cosine")) as index:
        with pytest.raises(error):
            index.replay(log(spark, rows))
        assert index.nodes().count() == 0


def test_replay_normalises_and_knows_its_ids(spark):
    with VectorIndex.create(spark, "memory:", IndexConfig(2, distance="cosine")) as index:
        index.replay(log(spark, [(1, 10, [3.0, 4.0], None), (2, 11, [0.0, 2.0], [])]))
        assert {r.external_id: [round(x, 6) for x in r.full_vector] for r in index.nodes().collect()} == {10: [0.6, 0.8], 11: [0.0, 1.0]}
        again = log(spark, [(0, 0, [1.0, 1.0], [])] * 2 + [(3, 10, [1.0, 0.0], [])]).where("log_offset = 2")
        with pytest.raises(InvalidArgumentError):
            index.replay(again)


def test_a_log_ahead_of_the_manifest_gives_no_id_twice(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, [float(i), 0.0]) for i in ids], "external_id bigint, vector array<float>")
    with VectorIndex.create(spark, f"file:{tmp_path}/x", IndexConfig(2)) as index:
        index.bulk_build(rows(1, 2))
        publish = index.storage.publish
        index.storage.publish = lambda *_: (_ for _ in ()).throw(OSError("killed"))
        with pytest.raises(OSError):
            index.insert(rows(3))
        index.storage.publish = publish
        index.insert(rows(4))
        ids = [r.node_id for r in index.mutations().collect()]
        assert len(set(ids)) == len(ids) == 2


def test_half_written_manifests_are_passed_over(spark, tmp_path):
    path = f"{tmp_path}/x"
    with VectorIndex.create(spark, f"file:{path}", IndexConfig(2)) as index:
        index.bulk_build(spark.createDataFrame([(1, [0.0, 1.0])], "external_id bigint, vector array<float>"))
        version = index.snapshot().version
    assert not [n for n in os.listdir(f"{path}/manifest") if "json" in n and not n.endswith((".json", ".crc"))]
    with open(f"{path}/manifest/v={version + 1:012d}.json", "w") as f:
        f.write('{"config": ')
    open(f"{path}/manifest/.v={version + 2:012d}.json.draft", "w").close()
    with VectorIndex.open(spark, f"file:{path}") as index:
        assert index.snapshot().version == version and index.nodes().count() == 1
        index.delete(spark.createDataFrame([(1,)], "external_id bigint"))
        assert index.snapshot().version == version + 1


def test_a_manifest_must_name_what_is_there(spark, tmp_path):
    for uri in ("memory:", f"file:{tmp_path}/y"):
        with VectorIndex.create(spark, uri, IndexConfig(2)) as index:
            m = index.storage.latest()
            for wrong in ({"segments": [{"ref": 77, "count": 1}]}, {"changes": [{"ref": 5, "count": 1}]}, {"quantizer": 9}, {"epoch": -1}):
                with pytest.raises(StorageError):
                    index.storage.publish(json.loads(json.dumps(m)) | wrong, m["version"])
            assert index.storage.latest() == m


def test_search_does_not_join_for_external_ids(spark):
    with VectorIndex.create(spark, "memory:", IndexConfig(2)) as index:
        index.bulk_build(spark.createDataFrame([(k + 50, [float(k), 0.0]) for k in range(9)], "external_id bigint, vector array<float>"))
        hits = index.search(spark.createDataFrame([(0, [0.0, 0.0])], "query_id bigint, vector array<float>"), 3)
        assert [(r.rank, r.external_id) for r in hits.orderBy("rank").collect()] == [(1, 50), (2, 51), (3, 52)]
        assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()


def test_code_sizes():
    assert [code_bytes(d, b) for d, b in ((1, 1), (64, 1), (65, 1), (64, 2))] == [8, 8, 16, 16]


@pytest.mark.parametrize("labels", [False, True])
@pytest.mark.parametrize("whole", [6000, 0])
def test_rounds_of_one_row_are_the_sequential_build(labels, whole, monkeypatch):
    import dataclasses

    from vecstrata.operators import graph as module

    monkeypatch.setattr(module, "WHOLE_MATRIX", whole)
    for seed, most in ((4, 8), (5, 3), (6, 1)):
        one, rounds = graph(seed, labels=labels, most=most), graph(seed, labels=labels, most=most)
        one.config = dataclasses.replace(one.config, build_round=1)
        for g in (one, rounds):
            g.routing[:] = np.round(g.routing * 4)  # whole numbers: both forms of a distance are exact
            g.routing[40:60] = g.routing[40]  # ties
        one.build()
        rounds.build_in_rounds(1)
        assert rounds.neighbors == one.neighbors


@pytest.mark.parametrize("labels", [False, True])
def test_pruning_together_is_pruning_alone(labels):
    g = graph(9, labels=labels)
    rng = np.random.default_rng(1)
    bases = np.arange(0, 120, 3)
    rows = np.full((len(bases), 70), -1)
    for k, base in enumerate(bases):
        some = rng.permutation([r for r in range(120) if r != base])[: rng.integers(0, 70)]
        rows[k, rng.permutation(70)[: len(some)]] = some
    got = g.prune_all(bases, rows, 8)
    for k, base in enumerate(bases.tolist()):
        mine = rows[k][rows[k] >= 0]
        assert [x for x in got[k].tolist() if x >= 0] == (g.prune(base, mine, g.between(base, mine), 8) if len(mine) else [])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 500])
def test_a_build_in_rounds_is_connected_and_finds(n):
    g = graph(11, n=n, most=12)
    g.build()
    assert len(g.neighbors) == n and all(len(x) <= 12 and k not in x and len(set(x)) == len(x) for k, x in enumerate(g.neighbors))
    g.neighbors = [[int(g.ids[x]) for x in near] for near in g.neighbors]
    assert len(g.breadth_first([1], n + 1)[0]) == n
    if n:
        hits = g.search_all(g.routing, g.full, [[1]] * n, 10, 40, [frozenset()] * n)
        d = ((g.routing[:, None] - g.routing) ** 2).sum(2)
        truth = np.argsort(d, 1, kind="stable")[:, :10]
        assert np.mean([len({r for _, r in h} & set(t.tolist())) / len(t) for h, t in zip(hits, truth, strict=True)]) > 0.97
