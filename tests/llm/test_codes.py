"""Vector codes against plain Lloyd rounds."""

import hashlib
import math
import random

import numpy as np

from vecstrata.llm.codes import Book, compress, digest_columns


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) of rows (vec_id, vector, label) and the digest of the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1])
    fits = [r for r in kept if len(r[1]) == width]
    ints = [[math.floor(256 * x) for x in r[1]] for r in fits]
    cut = [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]
    first = [[math.floor(256 * x) for x in r[1]] for r in order if len(r[1]) == width][:entries]
    books = [[tuple(v[a:b]) for v in first] for a, b in cut]

    def assign():
        far = lambda x, e: sum((p - q) ** 2 for p, q in zip(x, e, strict=True))
        return [[min((far(v[a:b], e), k) for k, e in enumerate(book)) for (a, b), book in zip(cut, books, strict=True)] for v in ints]

    for _ in range(rounds):
        got = assign()
        for p, (a, b) in enumerate(cut):
            for e in range(len(books[p])):
                mine = [v[a:b] for v, g in zip(ints, got, strict=True) if g[p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    got = assign()
    error = [sum(d for d, _ in g) for g in got]
    by = {}
    for r, e in zip(fits, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    found = [(r[0], "".join(f"{k:02x}" for _, k in g), e, by[r[2]]) for r, g, e in zip(fits, got, error, strict=True)]
    found += [(r[0], None, None, by.get(r[2])) for r in kept if len(r[1]) != width]
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def same(got, rows, **how):
    want, digest = plain_codes(rows, **how)
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got]
    assert sorted(got, key=repr) == sorted([(*w, digest) for w in want], key=repr)


SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, v int"


def test_odd_rows(spark):
    rng = random.Random(5)
    grid = lambda n: [rng.randrange(-3, 4) / 256 for _ in range(n)]  # noqa: E731  small whole numbers: many ties
    rows = [(k, grid(40), rng.choice([None, 1, 2, 3])) for k in range(150)]
    rows += [rows[3], rows[3], (3, grid(40), 7), (None, grid(40), None), (200, None, 1), (201, grid(39) + [None], 1), (202, [math.nan] * 40, 1), (203, [math.inf] + grid(39), 1), (204, grid(7), 2), (205, [], 2)]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA).repartition(4)
    same(digest_columns(compress(df)).collect(), rows)
    same(digest_columns(compress(df, entries=5, rounds=3, parts=3)).collect(), rows, entries=5, rounds=3, parts=3)


def test_few_rows_and_none(spark):
    rows = [(2, [0.5, -0.25], None), (1, [0.5, -0.25], 4), (9, [-1.0, 2.0], 4)]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    same(digest_columns(compress(df)).collect(), rows)
    assert digest_columns(compress(df.limit(0))).collect() == []
    nil = [(1, [], 1), (2, [], 1)]
    same(digest_columns(compress(spark.createDataFrame([(*r, "", 1) for r in nil], SCHEMA))).collect(), nil)


def test_numbers_beyond_doubles(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice([1e30, -1e30, 1e9 + rng.random(), 3e15, 0.0]) for _ in range(32)], k % 3) for k in range(90)]
    want, digest = plain_codes(rows, entries=8)
    got = {r.vec_id: r for r in digest_columns(compress(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), entries=8)).collect()}
    for i, code, error, _ in want:
        assert got[i].code == code and got[i].error == (error if error < 2**63 else None) and got[i].codebooks_sha256 == digest


def test_bounds_save_comparisons_and_keep_ties():
    """Codes followed through rounds equal full scans, with fewer scans."""
    rng = np.random.default_rng(1)
    for spread in (2, 3000):
        x = np.floor(rng.normal(0, spread, (4000, 4)))
        entries = x[:64].astype(int).tolist()
        book, scans = Book(entries, 4), 0
        code, upper, lower = book.scan(x)
        code = code.astype(np.uint8)
        for _ in range(6):
            new = [np.floor(x[code == e].mean(0)).astype(int).tolist() if (code == e).any() else entries[e] for e in range(64)]
            book = Book(new, 4, entries)
            scans += book.follow(x, code, upper, lower)
            entries = new
            assert (code == book.scan(x)[0]).all()
        assert spread == 2 or scans < 0.8 * 6 * len(x)


def test_table_against_plain(spark):
    folder = "/root/testdata/sf0.001"
    from vecstrata.llm import queries

    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    same(queries.queries()["op11_vector_codes"](spark, folder).collect(), [(r.vec_id, list(r.embedding), r.label) for r in e.collect()])
