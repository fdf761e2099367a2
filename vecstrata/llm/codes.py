"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd's rounds with Hamerly's bounds.

A component x becomes the whole number floor(256 x).  A vector is cut into equal
consecutive parts, and each part is replaced by the index of the nearest entry of
its codebook (squared Euclidean distance, ties to the lower index).  Codebooks
start as the parts of the rows with the smallest ids; a round assigns all parts and
moves each entry to the floored mean of its parts; unused entries stay.

With each part go two bounds from round to round, in a table of the shared folder:
an upper bound of the distance to its entry and a lower bound of the distance to
the second nearest.  After a round the upper one grows by how far the entry moved
and the lower one shrinks by the farthest move of any other entry.  While the upper
bound is strictly below the lower one, or below half the way from the entry to the
nearest other entry, no other entry can be as near, not even at a tie, and nothing
is compared.  Else the upper bound is made exact, and if that does not help, the
part is compared with all entries in whole numbers.  Bounds are rounded outwards.

Only the codebooks (entries x width numbers) and sums of the same size reach the
driver.  Whole numbers are held in doubles where all sums stay below 2**53, which
is exact, and in Python's integers elsewhere.

Defined cases: rows whose vector is null or holds null or non-finite components are
left out; the width is that of the row with the smallest id (ties: the smaller
vector; null ids last), and rows of any other width have a null code and error;
widths that the number of parts does not divide are cut as evenly as can be; fewer
rows than entries give smaller codebooks; an error beyond 64 bits is null, and so is
a sum beyond them; repeated rows count each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, sent, written

SCALE = 256
#: Sums are sent in pieces of so many bits, so that no size of table or number overflows.
LIMB = 40
#: Rows handled together.
TOGETHER = 1 << 13
LONG = 2**63

Batches = Iterator[pa.RecordBatch]


def cuts(width: int, parts: int) -> list[slice]:
    return [slice(k * width // parts, (k + 1) * width // parts) for k in range(parts)]


def whole_numbers(x: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 x), in doubles if all distances stay exact in them, else in Python's integers."""
    width = -(-x.shape[1] // parts)
    if not x.size or width * (2 * SCALE * (np.abs(x).max() + 1)) ** 2 < 2**53:
        return np.floor(x * SCALE)
    return np.array([[int(v) * SCALE if abs(v) > 2.0**52 else math.floor(v * SCALE) for v in row] for row in x], object).reshape(x.shape)


def plain(x: np.ndarray) -> list[int]:
    return [int(v) for v in x]


def between(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (lines) to entries (columns), exact."""
    if x.dtype != object and entries.dtype != object:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None]
    return ((x.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(2, initial=0)


def to_own(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if x.dtype != object and entries.dtype != object:
        return ((x - entries) ** 2).sum(1)
    return ((x.astype(object) - entries.astype(object)) ** 2).sum(1, initial=0)


def outward(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots in single precision, rounded up or down."""
    return rounded(np.sqrt(squared.astype(np.float64)), up)


def rounded(x: np.ndarray, up: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(np.inf if up else -np.inf))


class Book:
    """The entries of one part, and how far they are from each other and from where they were."""

    def __init__(self, entries: list[list[int]], width: int, before: list[list[int]] | None = None):
        exact = all(abs(v) < 2**23 for e in entries for v in e) and width < 64
        self.entries = np.array(entries, np.float64 if exact else object).reshape(len(entries), width)
        apart = between(self.entries, self.entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1, initial=np.inf)) / 2 * (1 - 1e-9)
        old = self.entries if before is None else np.array(before, self.entries.dtype).reshape(self.entries.shape)
        self.moved = np.sqrt(to_own(self.entries, old).astype(np.float64)) * (1 + 1e-9)
        order = np.argsort(-self.moved, kind="stable")
        self.others = np.full(len(entries), self.moved[order[0]])
        self.others[order[0]] = self.moved[order[1]] if len(order) > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest entry, upper bound, lower bound of the second nearest)."""
        d = between(x, self.entries)
        code = d.argmin(1)
        lines = np.arange(len(x))
        best = d[lines, code]
        d = d.astype(np.float64)
        d[lines, code] = np.inf
        return code, outward(best, True), outward(d.min(1), False)

    def follow(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring codes and bounds up to date in place; the number of parts that were compared with all entries."""
        step, most = self.moved[code], self.others[code]
        u, w = upper.astype(np.float64), lower.astype(np.float64)
        upper[:] = rounded(u + step + 1e-9 * (u + step), True)
        lower[:] = rounded(np.where(np.isinf(w), w, w - most - 1e-9 * (np.abs(w) + most)), False)
        bound = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(~(upper < bound))
        if len(open_):
            upper[open_] = outward(to_own(x[open_], self.entries[code[open_]]), True)
            open_ = open_[~(upper[open_] < bound[open_])]
        if len(open_):
            code[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return len(open_)


def binaries(x: np.ndarray) -> pa.Array:
    """The lines of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(x.tobytes())])


def lines(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A matrix that can be written to from binary values of one size."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width).copy()


def vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def pieces(batches: Batches) -> Batches:
    for b in batches:
        for at in range(0, b.num_rows, TOGETHER):
            yield b.slice(at, TOGETHER)


def _assign(books: list[Book], parts: int, width: int, final: bool) -> Callable[[Batches], Batches]:
    """Codes and bounds of all parts: from nothing where there are none yet, else followed; at the end errors instead of bounds."""

    def run(batches: Batches) -> Batches:
        for b in pieces(batches):
            x = whole_numbers(vectors(b.column("v"), width), parts)
            n = len(x)
            if "code" in b.schema.names:
                code, upper, lower = lines(b.column("code"), np.uint8, parts), lines(b.column("upper"), np.float32, parts), lines(b.column("lower"), np.float32, parts)
            else:
                code, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
            error = np.zeros(n, object)
            for p, (cut, book) in enumerate(zip(cuts(width, parts), books, strict=True)):
                mine = x[:, cut]
                if "code" in b.schema.names:
                    book.follow(mine, code[:, p], upper[:, p], lower[:, p])
                else:
                    code[:, p], upper[:, p], lower[:, p] = book.scan(mine)
                if final:
                    error += plain(to_own(mine, book.entries[code[:, p]]))
            if final:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), binaries(code), pa.array([e if e < LONG else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), binaries(code), binaries(upper), binaries(lower)], names=["vec_id", "label", "v", "code", "upper", "lower"])

    return run


def _sums(parts: int, entries: int, width: int) -> Callable[[Batches], Batches]:
    """Of each task, the number of parts of each entry and their sums by component, in limbs; component -1 is the number."""

    def run(batches: Batches) -> Batches:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((entries, width), object)
        for b in pieces(batches):
            x, code = whole_numbers(vectors(b.column("v"), width), parts), lines(b.column("code"), np.uint8, parts)
            for p, cut in enumerate(cuts(width, parts)):
                count[p] += np.bincount(code[:, p], minlength=entries)
                for k in range(cut.start, cut.stop):
                    if x.dtype == object:
                        np.add.at(total[:, k], code[:, p], x[:, k])
                    else:
                        total[:, k] += plain(np.bincount(code[:, p], x[:, k], entries))
        out = []
        for p, cut in enumerate(cuts(width, parts)):
            for e in np.flatnonzero(count[p]).tolist():
                out.append((p, e, -1, 0, int(count[p, e])))
                for k in range(cut.start, cut.stop):
                    left, limb = int(total[e, k]), 0
                    while left:
                        low = int(math.copysign(abs(left) % (1 << LIMB), left))
                        out.append((p, e, k, limb, low))
                        left, limb = (left - low) >> LIMB, limb + 1
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "limb", "x"])

    return run


def moved(state: DataFrame, books: list[list[list[int]]], parts: int, width: int) -> list[list[list[int]]]:
    """The entries after a round: floored means of their parts, unused ones as they were."""
    made = state.select("v", "code").mapInArrow(_sums(parts, len(books[0]), width), "part bigint, entry bigint, at bigint, limb bigint, x bigint")
    count: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int, int], int] = {}
    for r in made.groupBy("part", "entry", "at", "limb").agg(F.sum("x").alias("x")).collect():  # as many rows as the codebooks have numbers, a few times
        if r["at"] < 0:
            count[r.part, r.entry] = r.x
        else:
            key = r.part, r.entry, r["at"]
            total[key] = total.get(key, 0) + (r.x << LIMB * r.limb)
    return [
        [[total.get((p, e, k), 0) // count[p, e] for k in range(cut.start, cut.stop)] if (p, e) in count else entry for e, entry in enumerate(book)]
        for p, (cut, book) in enumerate(zip(cuts(width, parts), books, strict=True))
    ]


def _finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per row with a finite vector: vec_id, label, code (binary, a byte a part), error, label_error, codebooks (text)."""
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull()).where(_finite(F.col("v")))
    first = own.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    kinds = dict(own.dtypes)
    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    if not first:
        return spark.createDataFrame([], f"{shape}, code binary, error bigint, label_error bigint, codebooks string")
    width = len(first.v)
    fits = own.where(F.size("v") == width)
    low = [r.v for r in fits.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    start = whole_numbers(np.array(low, np.float64).reshape(len(low), width), parts)
    books = [[plain(e) for e in start[:, cut]] for cut in cuts(width, parts)]
    before: list = [None] * parts
    state, path = fits, None
    for k in range(rounds + 1):
        made = [Book(b, c.stop - c.start, o) for b, c, o in zip(books, cuts(width, parts), before, strict=True)]
        final = k == rounds
        kept = "code binary, error bigint" if final else f"v {kinds['v']}, code binary, upper binary, lower binary"
        now, at = written(state.mapInArrow(_assign(made, parts, width, final), f"{shape}, {kept}"))
        if path:
            discard(spark, [path])
        state, path = now, at
        if not final:
            before, books = books, moved(state, books, parts, width)
    odd = own.where(F.size("v") != width).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    coded = state.unionByName(odd)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")).withColumnRenamed("label", "of")
    numbers = kinds["label"] in ("tinyint", "smallint", "int", "bigint", "boolean", "float", "double", "date")
    text = ",".join(str(v) for book in books for e in book for v in e)
    joined = coded.join(sent(sums) if numbers else sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn("codebooks", F.lit(text))


def digest_columns(coded: DataFrame) -> DataFrame:
    """The result with the code in hex digits and the codebooks as their SHA-256."""
    text = coded.select("codebooks").first()
    digest = hashlib.sha256((text.codebooks if text else "").encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
