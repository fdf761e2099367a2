"""Exact and near de-duplication against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import components, normal, sha256, simhash
from oracle import connect, same

from vecstrata.llm import simhash as S
from vecstrata.llm.components import connected_components
from vecstrata.llm.exact_dedup import drop_exact_copies, exact_groups
from vecstrata.llm.queries import oracle_sql, queries
from vecstrata.llm.simhash import drop_near_copies, near_groups

FOLDER = "/root/testdata/sf0.001"


def test_exact_query_matches_sql(spark):
    same(queries()["op3_exact_dedup"](spark, FOLDER), connect(FOLDER), oracle_sql()["op3_exact_dedup"])


@pytest.mark.parametrize("bits", [2**26, 64])
def test_exact_odd_rows(docs, bits):
    got, rows = exact_groups(docs, max_filter_bits=bits).collect(), docs.collect()
    sizes = Counter(normal(r.text) for r in rows)
    assert Counter((r.doc_id, r.text_sha256, r.group_size) for r in got) == Counter((r.doc_id, sha256(normal(r.text)), sizes[normal(r.text)]) for r in rows)
    assert sum(r.kept for r in got) == len(sizes)
    ids = {}
    for r in rows:
        ids.setdefault(sha256(normal(r.text)), []).append(r.doc_id)
    for r in got:
        assert r.keep_id == min((x for x in ids[r.text_sha256] if x is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id


def test_exact_drop(docs, nothing):
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(normal(r.text) for r in rows) == Counter({normal(r.text) for r in docs.collect()})
    assert {r.doc_id for r in rows if normal(r.text) == "a b c d e f g h"} == {8}
    assert exact_groups(nothing).count() == drop_exact_copies(nothing).count() == 0


def test_fingerprints_match_the_definition():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 10, 200]:
        text = " ".join(rng.choice(["A", "b", "Cé", "d\x0bE", "\xa0f"]) for _ in range(n))
        assert S.fingerprint(text.encode()) == simhash(text)
    S.RUN, held = 7, S.RUN
    assert S.fingerprint(b"a b c d " * 50) == simhash("a b c d " * 50)
    S.RUN = held
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0


def test_near_groups_match_brute_force(spark, docs):
    got = near_groups(docs).collect()
    rows = [r for r in docs.collect() if r.doc_id is not None]
    prints = [simhash(r.text) for r in rows]
    want = components([r.doc_id for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == Counter((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, want))
    assert sum(r.doc_id is None for r in got) == 2 and all(r.component_id is None for r in got if r.doc_id is None)


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_of_crowded_fingerprints(spark, cell):
    """A cluster much larger than a cell, a chain, and scattered ones; small cells take the way of chunk pairs."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    fps = {center} | {center ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 5) for _ in range(40)}
    x = int(rng.integers(1 << 62))
    for b in range(0, 60, 3):
        x ^= 0b111 << b
        fps.add(x)
    fps |= {int(v) for v in rng.integers(1 << 62, size=50)}
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp bigint, rep bigint")
    held, S.CELL = S.CELL, cell
    try:
        got = {r.node: r.component for r in connected_components(S.near_links(rows)).collect()}
    finally:
        S.CELL = held
    want = components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert [got.get(k, k) for k in range(len(fps))] == want


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_every_pair_meets_in_a_cell(spark, blocks):
    rng = np.random.default_rng(blocks)
    pairs = []
    for k in range(60):
        x = int(rng.integers(1 << 62))
        pairs += [(x, 2 * k), (x ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)), 2 * k + 1)]
    cells = {}
    for r in S._cells(spark.createDataFrame(pairs, "fp bigint, rep bigint"), blocks, 3).collect():
        cells.setdefault(r.rep, set()).add(r.cell)
    assert all(cells[2 * k] & cells[2 * k + 1] for k in range(60))


def test_near_drop(docs, nothing):
    rows = drop_near_copies(docs).collect()
    groups = near_groups(docs).collect()
    stay = {r.component_id for r in groups}
    assert {r.doc_id for r in rows} == stay and near_groups(nothing).count() == drop_near_copies(nothing).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 500 for k in range(500, 560)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
