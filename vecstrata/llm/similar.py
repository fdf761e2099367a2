"""Near copies of a given shingle similarity, found with SimHash and verified.

Two texts are near copies if the Jaccard similarity of their sets of word
shingles is ``LEAST`` or more.  Such sets share one of the first
n - ceil(LEAST * n) + 1 of their n shingles in any order that is the same for
all texts (prefix filter).  The order is by how often a shingle occurs, so
common lines come last; the counts are those of ``BUCKETS`` hash buckets, and
sharing them changes the order but not the result.  These shingles name the
cells, and only rows of a cell meet.

Most cells have one row.  Tasks send the cells of batches of texts, compressed,
to slots, ranges of the hashes; a slot gives back only the cells that two texts
or more have, and only these become rows.

In a cell, pairs within ``LIMIT`` bits of a 64-bit SimHash over the shingle sets
are found with the pivot distance tables of ``simhash``.  Of these the ones whose
sizes allow the similarity and that are within ``WIDE`` of all ``64 * HASHES``
bits are candidates.  At similarity 0.8 a bit differs with probability 0.15: 9.7 of
64 bits with a deviation of 2.9, and 38.6 of 256 with 5.7, so either limit is some
five deviations off, while texts that have a passage in common seldom pass the
second.  First a spanning forest of each cell's candidates is verified on the
shingle sets.  Where a cell still has several components, candidates must also
pass a certain bound: their sets are counted in ``BINS`` bins, and the smaller
counts of each bin add up to no less than what the sets have in common.  Of
these again a spanning forest is verified, and then all that are not yet in one
component, so a large group of near copies gives few more pairs than rows.

Defined cases: null and blank texts have no shingles and are copies of each
other; texts with fewer words than a shingle are one shingle; words are what
white space separates, with ASCII letters lower-cased; rows with a null id stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lean import lean
from .packing import packed, runs, unpacked
from .scratch import sent, settle
from .simhash import SEED, dealt, link_batches
from .words import BASE, NOT_BLANK, chunks, hashed_words, mixed

WORDS, LEAST, LIMIT = 5, 0.8, 24
#: 64-bit hashes of a shingle that the whole SimHash is made of, and the bits of it that may differ.
HASHES, WIDE = 4, 68
BUCKETS, BLOCK = 1 << 22, 1 << 16
#: Bins that a shingle set is counted in; counts stop at 255, and a set that reaches it passes any bound.
BINS = 256
#: Shingles that are turned to bits at a time.
RUN = 1 << 16
#: Bytes of text whose cells leave a task together; cells that a slot holds on average, and least number of slots.
BATCH, SLOT, LEAST_SLOTS = 1 << 23, 1 << 20, 64
PRINT = "slot bigint, batch bigint, n bigint, cells binary, owners binary, doc_id bigint, digest bigint, fp bigint, wide binary, bins binary, size bigint"


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = hashed_words(texts, NOT_BLANK)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = min(words, e - s)
        key = np.zeros(e - s - size + 1 if size else 0, np.uint64)
        for k in range(size):
            key = mixed(key + h[s + k : s + k + len(key)])
        out.append(np.unique(key))
    return out


def _fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set: ``HASHES`` numbers, the first from the shingles' own hashes."""
    ones = np.zeros(64 * HASHES, np.int64)
    for at in range(0, len(found), RUN):
        part = found[at : at + RUN]
        every = np.stack([part, *(mixed(part + BASE * np.uint64(k)) for k in range(1, HASHES))], 1)
        bits = np.unpackbits(every.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")


def _bins(found: np.ndarray) -> bytes:
    """How many shingles of a set are in each bin."""
    at = (mixed(found) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=BINS), 255).astype(np.uint8).tobytes()


def _may_be(least: float, bins: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs the bins do not rule out."""
    keep = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        x, y = bins[i[at : at + (1 << 14)]], bins[j[at : at + (1 << 14)]]
        most = np.minimum(x, y).sum(1, dtype=np.int64)
        both = size[i[at : at + (1 << 14)]] + size[j[at : at + (1 << 14)]]
        keep[at : at + (1 << 14)] = (most >= least * (both - most) - 1e-9) | (x == 255).any(1) | (y == 255).any(1)
    return keep


def _alike(least: float):
    """A check of pairs by their sizes and whole SimHashes, and by their bins where the rows have them."""

    def checked(rows: pa.Table):
        size = rows.column("size").to_numpy()
        wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), "<u8").reshape(len(size), -1)
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(len(size), -1) if "bins" in rows.column_names else None

        def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            keep = least * np.maximum(size[i], size[j]) <= np.minimum(size[i], size[j]) + 1e-9
            keep[keep] = np.bitwise_count(wide[i[keep]] ^ wide[j[keep]]).sum(1) <= WIDE
            if bins is not None:
                keep[keep] = _may_be(least, bins, size, i[keep], j[keep])
            return keep

        return check

    return checked


def _count_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for texts in chunks(t.as_py() for t in b.column(0)):
                for s in shingles(texts, words):
                    np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
        for k in range(BUCKETS // BLOCK):
            part = total[k * BLOCK : (k + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.astype("<u4").tobytes()], pa.binary())], names=["block", "counts"])

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, codes of the summed counts, their total)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
    for block, x in sums.items():
        codes = np.minimum(np.rint(8 * np.log2(1 + x)), 255).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([codes], pa.binary()), pa.array([int(x.sum())], pa.int64())], names=["block", "codes", "total"])


def _print_batches(shared, words: int, least: float, slots: int):
    """Of each batch of texts a row for each text (slot -1, its number in the batch as n) and one for each slot with the cells there and the texts that have them."""

    def leave(batch: int, ids: list, digests: list[int], prints: list[tuple], cells: list[np.ndarray]) -> pa.RecordBatch:
        first = {}
        for k, d in enumerate(digests):
            first.setdefault(d, k)
        mine = sorted(first.values())  # equal sets send their cells once
        every = np.concatenate([*(cells[k] for k in mine), np.zeros(0, np.uint64)])
        owner = np.repeat(mine, [len(cells[k]) for k in mine]).astype(np.int64) if mine else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        slot = (every >> np.uint64(40)) * np.uint64(slots) >> np.uint64(24)
        cuts = np.flatnonzero(np.diff(slot, prepend=np.uint64(1 << 63), append=np.uint64(1 << 63))) if len(slot) else np.zeros(1, np.int64)
        out = [(-1, batch, k, None, None, i, d - (d >> 63 << 64), *x) for k, (i, d, x) in enumerate(zip(ids, digests, prints, strict=True))]
        out += [(int(slot[x]), batch, int(y - x), packed(np.diff(every[x:y], prepend=np.uint64(0))), packed(owner[x:y]), *[None] * 6) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        kinds = [pa.binary() if t == "binary" else pa.int64() for _, t in (x.split() for x in PRINT.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PRINT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, batch = np.frombuffer(shared.value, np.uint8), TaskContext.get().partitionId() << 32
        ids, digests, prints, cells, size = [], [], [], [], 0
        for b in batches:
            at = 0
            for texts in chunks(t.as_py() for t in b.column(1)):
                for s in shingles(texts, words):
                    digests.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    wide = _fingerprint(s)
                    prints.append((int(wide[:1].view("<i8")[0]), wide.tobytes(), _bins(s), len(s)))
                    n = len(s) - ceil(least * len(s) - 1e-9) + 1 if len(s) else 0
                    cells.append(s[np.lexsort((s, often[s & np.uint64(BUCKETS - 1)]))[:n]])
                ids += b.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                size += sum(map(len, texts))
                if size >= BATCH:
                    yield leave(batch, ids, digests, prints, cells)
                    batch, ids, digests, prints, cells, size = batch + 1, [], [], [], [], 0
        if ids:
            yield leave(batch, ids, digests, prints, cells)

    return run


def _met_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, batch, n) of the cells of a slot that are named twice or more."""
    for rows in runs(batches, "slot"):
        cells = np.concatenate([np.cumsum(unpacked(r["cells"], r["n"]), dtype=np.uint64) for r in rows])
        order = np.argsort(cells, kind="stable")
        same = cells[order][1:] == cells[order][:-1]
        met = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        batch = np.repeat([r["batch"] for r in rows], [r["n"] for r in rows])
        owner = np.concatenate([unpacked(r["owners"], r["n"]).astype(np.int64) for r in rows])
        for at in range(0, len(met), 1 << 16):
            k = met[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cells[k].view(np.int64)), pa.array(batch[k]), pa.array(owner[k])], names=["cell", "batch", "n"])


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in chunks(t.as_py() for t in b.column(1)):
                made = [s.tobytes() for s in shingles(texts, words)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(made)), pa.array(made, pa.binary())], names=["id", "held"])
                at += len(made)

    return run


def _verify_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                common = len(p) + len(q) - len(np.union1d(p, q)) if least * max(len(p), len(q)) <= min(len(p), len(q)) + 1e-9 else 0
                keep.append(common >= least * (len(p) + len(q) - common) - 1e-9)
            made = b.filter(pa.array(keep, pa.bool_()))
            yield made.select(["a", "b"])

    return run


def _verified(pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose texts have the similarity."""
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = settle(rows.join(sent(settle(ids)), F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(lean(_set_batches(words)), "id bigint, held binary"))
    x, y = (sets.select(F.col("id").alias(f"of_{k}"), F.col("held").alias(f"in_{k}")) for k in ("a", "b"))
    both = pairs.join(x, F.col("a") == F.col("of_a")).join(y, F.col("b") == F.col("of_b")).select("a", "b", "in_a", "in_b")
    return settle(both.mapInArrow(lean(_verify_batches(least)), "a bigint, b bigint").distinct())


def _still_open(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of the cells that have several components, with a column component."""
    joined = settle(cells.join(parts, F.col("rep") == F.col("node"), "left").select(*cells.columns, F.coalesce("component", "rep").alias("component")))
    several = joined.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("cell").alias("met"))
    return joined.join(several, F.col("cell") == F.col("met")).select(*cells.columns, "component")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, limit: int = LIMIT) -> DataFrame:
    """(doc_id, component_id) of the rows with an id; the component is its smallest id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    often, total = np.zeros(BUCKETS, np.uint8), 0
    counts = rows.select("text").mapInArrow(lean(_count_batches(words)), "block bigint, counts binary").repartition("block")
    for r in counts.mapInArrow(lean(_sum_batches), "block bigint, codes binary, total bigint").collect():  # BUCKETS bytes in all
        often[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.codes, np.uint8)
        total += r.total
    shared = docs.sparkSession.sparkContext.broadcast(often.tobytes())
    slots = max(LEAST_SLOTS, int(total * (1 - least)) // SLOT)
    made = settle(rows.mapInArrow(lean(_print_batches(shared, words, least, slots)), PRINT))
    prints = made.where("slot < 0").select("batch", "n", "doc_id", "digest", "fp", "wide", "bins", "size")
    least_ids = settle(prints.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    nodes = prints.join(least_ids, "digest").select("batch", "n", "fp", "wide", "bins", "size", "rep")
    met = made.where("slot >= 0").select("slot", "batch", "n", "cells", "owners").repartition("slot").sortWithinPartitions("slot").mapInArrow(lean(_met_batches), "cell bigint, batch bigint, n bigint")
    cells = settle(met.join(nodes, ["batch", "n"]).select("cell", "fp", "wide", "size", "rep").distinct())
    links = _verified(dealt(cells).mapInArrow(lean(link_batches(limit, False, _alike(least))), "a bigint, b bigint"), rows, words, least)
    parts = settle(connected_components(links))
    kinds = nodes.select("rep", "wide", "size", "bins").dropDuplicates(["rep", "wide", "size"])
    held = settle(_still_open(cells, parts).join(kinds, ["rep", "wide", "size"]).select("cell", "fp", "wide", "size", "bins", "rep"))
    links = links.unionByName(_verified(dealt(held).mapInArrow(lean(link_batches(limit, False, _alike(least))), "a bigint, b bigint"), rows, words, least))
    held = settle(_still_open(held, settle(connected_components(links))))
    rest = _verified(dealt(held).mapInArrow(lean(link_batches(limit, True, _alike(least))), "a bigint, b bigint"), rows, words, least)
    parts = connected_components(links.unionByName(rest))
    known = settle(least_ids.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("component", "rep").alias("component_id")))
    return prints.select("doc_id", "digest").join(known, F.col("digest") == F.col("of")).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows with a null id stay."""
    gone = settle(similar_groups(docs, id_col, text_col, words, least).where("component_id <> doc_id").select("doc_id").distinct())
    name = "_" + max(docs.columns, key=len)
    return docs.join(sent(gone.withColumnRenamed("doc_id", name)), F.col(id_col) == F.col(name), "left_anti")
