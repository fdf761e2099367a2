"""Bounded reachability by joins against a queue."""

import random
from collections import deque

import pytest

from vecstrata.operators.shards import reachable_bounded


def by_queue(lists, starts, max_visited, max_candidates):
    """[(node, rank, present)] visited one after the other, and whether a limit left something out."""
    queue, queued, out, cut = deque(sorted(set(starts))), set(starts), [], False
    while queue:
        if len(out) >= max_visited:
            return out, True
        node = queue.popleft()
        out.append((node, len(out), node in lists))
        for x in lists.get(node, []):
            if x not in queued:
                if len(queued) >= max_candidates:
                    cut = True
                    break
                queued.add(x)
                queue.append(x)
    return out, cut


@pytest.mark.parametrize(("max_visited", "max_candidates"), [(1000, 1000), (40, 1000), (1000, 37), (25, 60), (3, 3), (2, 1), (0, 10), (97, 97)])
def test_equals_a_queue(spark, max_visited, max_candidates):
    rng = random.Random(8)
    lists = {k: [rng.randrange(1, 120) for _ in range(rng.randrange(0, 4))] for k in range(1, 100)}
    lists[50] = None
    starts = [7, 3, 3, 110]
    nodes = spark.createDataFrame(list(lists.items()), "node_id bigint, neighbors array<bigint>").repartition(3)
    got = reachable_bounded(nodes, spark.createDataFrame([(x,) for x in starts], "node_id bigint"), max_visited, max_candidates).collect()
    want, cut = by_queue({k: v or [] for k, v in lists.items()}, starts, max_visited, max_candidates)
    assert sorted((r.node_id, r.rank, r.present) for r in got if r["rank"] < max_visited) == sorted(want)
    if max_visited:
        assert {r.truncated for r in got} == {cut}


def test_nothing_to_start_from(spark):
    nodes = spark.createDataFrame([(1, [2])], "node_id bigint, neighbors array<bigint>")
    assert reachable_bounded(nodes, nodes.select("node_id").limit(0), 5, 5).collect() == []
