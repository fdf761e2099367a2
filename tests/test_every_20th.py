"""Searches are asked for every row whose id is divisible by 20; their rows are compared with SQL in test_catalogue.py."""

import pytest

from vecstrata import queries as catalogue

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["topk_l2", "hamming_topk"])
def test_whole_query_set(spark, name):
    rows = catalogue.queries()[name](spark, FOLDER).collect()
    assert {r.query_id for r in rows} == set(range(0, 2000, 20)) and len(rows) == 1000


def test_every_search_has_the_whole_set():
    searches = [n for n, sql in catalogue.SQL.items() if "from embeddings q" in sql or "from codes q" in sql]
    assert len(searches) >= 10 and all("q.vec_id % 20 = 0" in catalogue.SQL[n] for n in searches)
