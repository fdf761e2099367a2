"""Walks of many queries at once: what they leave out must not change what they find."""

import numpy as np
import pytest

from vecstrata import IndexConfig, Quantizer, QueryBudget
from vecstrata.operators import graph as module
from vecstrata.operators.graph import Graph
from vecstrata.operators.shards import Nearest, encode_queries
from vecstrata.plans.exact import pair_distances

WIDE = QueryBudget(max_visited=10**6, max_candidates=10**6, max_rescore=10**6, max_query_bytes=1 << 30)


def built(seed, n=90, d=8, metric="l2", labels=False, quantizer=None, copies=0):
    """A wired graph over float32 vectors, some of which are equal, and queries, of which some are rows."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[n - copies :] = v[:copies]
    v = v.astype(np.float32).astype(np.float64)
    config = IndexConfig(d, distance=metric, max_neighbors=8, build_search_list_size=16, has_labels=labels, quantizer=quantizer)
    stats = (n, v.mean(0), ((v - v.mean(0)) ** 2).sum(0))
    routing, full = encode_queries(v, config, stats)
    sets = [frozenset(rng.integers(0, 4, 2).tolist()) if labels else frozenset() for _ in range(n)]
    g = Graph(config, np.arange(1, n + 1), np.arange(n), routing, full, sets, [[] for _ in range(n)])
    g.build()
    g.neighbors = [[int(g.ids[x]) for x in near] for near in g.neighbors]
    return g, *encode_queries(np.vstack((v[::4], rng.normal(size=(20, d)))), config, stats)


def single(g, routing, full, starts, limit, width, want=frozenset()):
    return [g.search(r, f, starts, limit, width, want, budget=WIDE) for r, f in zip(routing, full, strict=True)]


def stepwise(g, routing, full, starts, limit, width, want=frozenset(), rescoring=True):
    """All queries' walks carried out, and their rows looked through one by one."""
    visited, dist = g.walk_all(routing, [starts] * len(full), width)
    line, column = np.nonzero(visited >= 0)
    if rescoring:
        dist[line, column] = pair_distances(g.config.distance, full, line, g.full, visited[line, column])
    return [sorted((d, r) for d, r in zip(ds, rs, strict=True) if r >= 0 and (not want or want & g.labels[r]))[:limit] for ds, rs in zip(dist.tolist(), visited.tolist(), strict=True)]


def no_steps(*_):
    raise AssertionError("a walk went step by step")


def test_a_list_for_all_rows_needs_no_steps(monkeypatch):
    """with room for all rows the order of a walk does not matter."""
    g, routing, full = built(1, copies=30)
    want = single(g, routing, full, [1], 10, 10**5)
    monkeypatch.setattr(module, "walk_together", no_steps)
    got = g.search_all(routing, full, [[1]] * len(full), 10, 10**5, [frozenset()] * len(full))
    assert got == want
    lost = g.neighbors[5]
    for near in g.neighbors:
        near[:] = [x for x in near if x != 6]
    g.neighbors[5] = lost  # no edge leads to node 6 any more
    got = g.search_all(routing, full, [[1]] * len(full), 90, 10**5, [frozenset()] * len(full))
    assert all(len(x) == 89 and 5 not in {r for _, r in x} for x in got)


def test_what_is_farther_than_a_task_has_found_is_not_sent():
    """hits of later shards are fewer, and the nearest of all shards stay."""
    graphs = [built(seed, copies=20)[0] for seed in (2, 3, 4, 5)]
    asked = built(2, copies=20)[2]
    nearest, sent, all_ = Nearest(len(asked), 5), [], []
    for at, g in enumerate(graphs):
        line, row, dist = g.hits(asked, asked, [([1], frozenset())], np.zeros(len(asked), np.int64), 5, 10**5, True, nearest.bound)
        nearest.add(line, dist)
        sent.append([(k, d, at, r) for k, r, d in zip(line.tolist(), row.tolist(), dist.tolist(), strict=True)])
        all_ += [(k, d, at, r) for k, found in enumerate(single(g, asked, asked, [1], 5, 10**5)) for d, r in found]
    assert len(sent[0]) == 5 * len(asked) and len(sent[-1]) < 3 * len(asked)
    best = lambda hits: [sorted(h for h in hits if h[0] == k)[:5] for k in range(len(asked))]
    assert best(sum(sent, [])) == best(all_)


@pytest.mark.parametrize(("limit", "width"), [(1, 1), (5, 12), (10, 40), (10, 64)])
@pytest.mark.parametrize("kind", [{}, {"labels": True}, {"quantizer": Quantizer(2)}, {"metric": "cosine"}, {"metric": "inner_product"}])
def test_short_walks_told_from_distances_are_walks(kind, limit, width):
    """F8: rows of walks that are not carried out, and of those that are, are the same, whatever the entries."""
    for seed in (6, 7):
        g, routing, full = built(seed, n=110, copies=25, **kind)
        for starts in ([1], [40], [3, 50, 90], []):
            for want in (frozenset(), frozenset({1, 3})) if kind.get("labels") else (frozenset(),):
                for rescoring in (True, False):
                    got = g.search_all(routing, full, [starts] * len(full), limit, width, [want] * len(full), rescoring)
                    assert got == stepwise(g, routing, full, starts, limit, width, want, rescoring)


def test_few_short_walks_are_carried_out(monkeypatch):
    """F8: that a walk visits the nearest rows is known from the distances, as a rule."""
    g, routing, full = built(8, n=125, d=16)
    want, walked = single(g, routing, full, [1], 10, 64), []
    together = module.walk_together
    monkeypatch.setattr(module, "walk_together", lambda n, k, *rest: walked.append(k) or together(n, k, *rest))
    assert g.search_all(routing, full, [[1]] * len(full), 10, 64, [frozenset()] * len(full)) == want
    assert sum(walked) < len(full) / 4


@pytest.mark.parametrize("n", [300, 700])
def test_a_long_list_takes_no_more_memory_than_the_shard(n):
    """a list may be as long as the whole table, of which a shard has only a part."""
    import tracemalloc

    g, routing, full = built(9, n=n)
    want = stepwise(g, routing, full, [1], 10, n)
    tracemalloc.start()
    try:
        got = g.search_all(routing, full, [[1]] * len(full), 10, 10**6, [frozenset()] * len(full))
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
    assert got == want


def test_a_repair_searches_once(spark, monkeypatch):
    """the rows that stand in for removed entry nodes, the labels' and whether it was cut short come from one search."""
    from vecstrata import VectorIndex
    from vecstrata import index as facade

    met, search = spark.sparkContext.accumulator(0), facade.reachable

    def counted(nodes, *rest):
        def seen(batches):
            for b in batches:
                met.add(b.num_rows)
                yield b

        out = search(nodes, *rest)
        return out.mapInArrow(seen, out.schema)

    monkeypatch.setattr(facade, "reachable", counted)
    rows = spark.createDataFrame([(k, [float(k), 0.0], [k % 2]) for k in range(30)], "external_id bigint, vector array<double>, labels array<smallint>")
    with VectorIndex.create(spark, "memory:", IndexConfig(2, max_neighbors=4, has_labels=True)) as ix:
        ix.bulk_build(rows)
        ix.delete(rows.where("external_id = 0").select("external_id"))
        assert met.value == 30
        mine = ix.snapshot().manifest["starts"]["0"]
        assert mine["default"] == 2 and mine["labeled"].keys() == {"0", "1"} and 1 not in mine["labeled"].values()


def test_cosine_ties_at_zero_go_to_the_smaller_row(monkeypatch):
    """rows a rounding apart, whose distances are all held to be zero, tie; no steps are needed."""
    g, routing, full = built(10, metric="cosine", copies=40)
    for k in range(40, 50):
        g.full[k] = g.full[0] * (1 + (50 - k) * 1e-8)  # beyond unit length, the first one most
    want = stepwise(g, routing, full, [1], 6, 90)
    monkeypatch.setattr(module, "walk_together", no_steps)
    got = g.search_all(routing, full, [[1]] * len(full), 6, 10**5, [frozenset()] * len(full))
    assert got == want and [d for d, _ in got[0][:3]] == [0.0] * 3


def test_inner_products_of_long_and_short_rows_need_no_steps(monkeypatch):
    """the bound for rounding follows the longest row."""
    g, routing, full = built(11, metric="inner_product", copies=20)
    g.full[::7] *= 1e6
    g.full[3::7] *= 1e-6
    want = stepwise(g, routing, full, [1], 10, 90)
    monkeypatch.setattr(module, "walk_together", no_steps)
    assert g.search_all(routing, full, [[1]] * len(full), 10, 10**5, [frozenset()] * len(full)) == want


@pytest.mark.parametrize("rescoring", [True, False])
def test_codes_with_many_ties_need_no_steps(monkeypatch, rescoring):
    """few bits tie often; with rescoring the full vectors decide, else the smaller row."""
    g, routing, full = built(12, d=4, quantizer=Quantizer(1), copies=20)
    want = stepwise(g, routing, full, [1], 10, 90, rescoring=rescoring)
    monkeypatch.setattr(module, "walk_together", no_steps)
    assert g.search_all(routing, full, [[1]] * len(full), 10, 10**5, [frozenset()] * len(full), rescoring) == want


def test_filters_of_their_own_need_no_steps(monkeypatch):
    """each query meets the rows that its own filter admits, none if no row has its labels."""
    g, routing, full = built(13, labels=True, copies=20)
    kinds = [frozenset({1, 3}), frozenset({0}), frozenset({9}), frozenset()]
    wanted = [kinds[k % 4] for k in range(len(full))]
    want = [single(g, routing[k : k + 1], full[k : k + 1], [1, 4], 30, 90, w)[0] for k, w in enumerate(wanted)]
    monkeypatch.setattr(module, "walk_together", no_steps)
    assert g.search_all(routing, full, [[1, 4]] * len(full), 30, 10**5, wanted) == want and want[2] == []
