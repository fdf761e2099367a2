"""Archives written and read back, their order, and the parts of the merge."""

import hashlib
import random

import pytest
from oracle import connect, same

from vecstrata.llm import warc
from vecstrata.llm.queries import oracle_sql, queries
from vecstrata.llm.warc import LoserTree, captures, parse, record, remove_archives, url_key

LONG = "<p>" + "long page " * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://www.Example{k % 4}.com:80/b/{9 - k}?q=1#f", LONG if k % 3 == 0 else f"page {k}", "x") for k in range(12)]
    rows += [(20, "http://e.org/", "short"), (21, "http://e.org/", "short"), (22, None, None), (None, "not a url \r\n", LONG), (9, "http://e.org/9", LONG), (30, "https://[bad", "é" * 600), (31, "ftp://h:21/x", "é" * 600)]
    return spark.createDataFrame([(*r, "x")[:4] for r in rows], "page_id bigint, url string, html string, record_type string").repartition(3)


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    same(queries()["op6_warc"](spark, folder), connect(folder), oracle_sql()["op6_warc"])


@pytest.mark.parametrize("spill", [100_000, 3])
def test_round_trip_in_order(spark, pages, spill, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", spill)
    records, index, folder = captures(pages)
    got, rows = records.collect(), pages.collect()
    order = [(r.url_key, r.stamp, r.page_id is None, r.page_id or 0) for r in index.collect()]
    assert len(got) == len(rows)
    runs = {}
    for r in index.rdd.mapPartitionsWithIndex(lambda k, it: [(k, r.url_key, r.stamp) for r in it]).collect():
        runs.setdefault(r[0], []).append(r[1:])
    assert all(v == sorted(v) for v in runs.values())
    assert order == sorted(order)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted((r.page_id if r.page_id is not None else -1, len((r.html or "").encode()), digest(r.html)) for r in rows)
    assert sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest) for r in got) == want
    for r in got:
        if r.payload_digest == digest(LONG):
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 9 else ("revisit", 9))
        elif r.payload_digest == digest("é" * 600):
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 31 else ("revisit", 31))
        else:
            assert r.record_type == "response" and r.refers_to is None
        assert (r.payload is None) == (r.record_type == "revisit")
    remove_archives(spark, folder)


def test_empty(pages):
    records, index, _ = captures(pages.limit(0))
    assert records.count() == index.count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_record_and_keys():
    raw = record(7, "http://a/b c\n", b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert parse(raw)["payload"] == b"body" and b"\r\nWARC-Target-URI: http://a/b%20c%0A\r\n" in raw
    with pytest.raises(ValueError):
        parse(raw.replace(b"body", b"bodY"))
    assert url_key("http://www.Example.com:80/A?Q=1#x") == "com,example)/a?q=1" and url_key("https://h:8443") == "h:8443)/" and url_key(None) == ")/"
