"""Every query that has SQL gives the rows that DuckDB gives."""

import pytest
from oracle import connect, same

from vecstrata import queries as catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, con, name):
    same(catalogue.queries()[name](spark, FOLDER), con, catalogue.SQL[name])


@pytest.mark.parametrize("name", ["topk_cosine", "cosine_normalised", "topk_l2", "topk_inner_product", "sbq_two_phase"])
def test_matches_sql_on_more_rows(spark, name):
    """Distances that lie near a rounding step only show on more rows than the smallest table has."""
    folder = "/root/testdata/sf0.01"
    same(catalogue.queries()[name](spark, folder), connect(folder), catalogue.SQL[name])


def test_every_query_is_listed(spark):
    import __spark_entry__ as e

    assert set(catalogue.SQL) <= set(e.queries())
    assert e.entry(spark).count() == 10 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert set(catalogue.queries()) - set(catalogue.SQL) == {"graph_walk_small_l"}


def test_small_lists_find_most(spark):
    got = {(r.query_id, r.vec_id) for r in catalogue.queries()["graph_walk_small_l"](spark, FOLDER).collect()}
    true = {(r.query_id, r.vec_id) for r in catalogue.queries()["topk_l2"](spark, FOLDER).collect()}
    assert len(got & true) >= 0.9 * len(true)
