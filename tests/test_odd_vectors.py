"""Searches over rows and queries of several widths, with numbers that are not finite, and far from the origin."""

import math

import pytest

from vecstrata import IndexConfig, QueryBudget, VectorIndex
from vecstrata.plans import exact_topk


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_a_row_meets_queries_of_its_width(spark, metric):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, None), (None, [1.0, 0.0]), (7, [])]
    asked = [(10, [1.0, 0.0]), (11, [0.0, 0.0, 1.0]), (12, [1.0]), (13, [math.nan, 0.0]), (14, []), (15, None)]
    schema = "vec_id bigint, embedding array<double>"
    got = exact_topk(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), 5, metric).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(10, 1), (10, 2), (11, 3)]


def test_both_walks_give_the_same_digits(spark):
    """With and without counted budgets, far from the origin."""
    data = [(k, [1000.0 + k / 512, 2000.0 - k / 512, 3000.0]) for k in range(40)]
    index = VectorIndex.create(spark, "memory:", IndexConfig(3, max_neighbors=8, build_search_list_size=16))
    index.bulk_build(spark.createDataFrame(data, "external_id bigint, vector array<double>"))
    q = spark.createDataFrame(data[:5], "query_id bigint, vector array<double>")
    free = index.search(q, 5, 40, budget=QueryBudget(max_visited=100, max_candidates=1000, max_rescore=100, max_query_bytes=1 << 30)).collect()
    counted = index.search(q, 5, 40, budget=QueryBudget(max_visited=40, max_candidates=41, max_rescore=40, max_query_bytes=1 << 14)).collect()
    assert sorted(map(tuple, free)) == sorted(map(tuple, counted))
    assert {r.query_id: r.distance for r in free if r["rank"] == 1} == dict.fromkeys(range(5), 0.0)
