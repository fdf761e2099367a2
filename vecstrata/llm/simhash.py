"""SimHash near-de-duplication over pivot distance tables.

Each text gets a 64-bit SimHash of its word shingles.  For each distinct
fingerprint the Hamming distances to reference fingerprints (pivots) form its
row of the distance table.  By the triangle inequality two fingerprints within
distance t differ by at most t in every coordinate, so a pair whose maximum
coordinate difference is larger is discarded, and the survivors are verified on
the fingerprints themselves.

The first references are zero and, for each of the 32 pairs of neighbouring bits,
the fingerprint that has just these two set.  Their distances say how many bits
of each pair are set, (d(x, 0) + 2 - d(x, pair)) / 2, and one differing bit
changes one of these 32 coordinates.  So two fingerprints within distance t that
have their coordinates dealt into groups agree on all but t groups.  Each set of
(groups - t) groups names the table's cells by its coordinates, and only rows of
a cell meet; the more rows, the more groups (``groups_for``).  In a cell, rows
are sorted by their distance to the first of 16 further, spread-out references
and walked in windows of width t; the other 15 coordinates and then the
verification cut what is left.  Of the pairs found only those that join two so
far unjoined rows of the cell are emitted, a spanning forest, so a cell of G
rows gives under G links.  Cells over ``CELL`` rows are dealt out as pairs of
chunks to different tasks; nothing is capped.

Defined cases: null and empty texts and texts of white space only have
fingerprint zero and link like any other; texts with fewer words than a
shingle are one shingle; rows with a null id have a fingerprint, take part in
no link and get no component; repeated rows are reported each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lean import lean
from .scratch import sent, settle

SEED = 42
#: Largest cell that one task compares; larger ones are dealt out in chunks of half.
CELL = 4096
#: Shingles hashed at a time, so a long text needs bounded memory.
RUN = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text: a bit is one if set in over half of the shingles' XXH64."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, RUN):
        spans = zip(starts[at : min(at + RUN, n)].tolist(), last[at : at + RUN].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a bigint, one row per row of ``docs``."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(lean(_fingerprint_batches(words)), "doc_id bigint, fp bigint")


def groups_for(rows: int, most: int = 3) -> int:
    """How many groups of coordinates keep a cell of evenly spread fingerprints at some hundred rows or fewer."""
    groups = most + 1
    # two such fingerprints agree on a coordinate in 6 of 16 cases
    while rows * (6 / 16) ** (32 * (groups - most) / groups) > 256 and groups < 2 * most + 4:
        groups += 1
    return groups


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def coordinates(fp: Column) -> Column:
    """How many bits of each pair are set, from the distances to zero and to the pair: 32 numbers of two bits."""
    odd = F.lit(_signed(0x5555555555555555)).cast("bigint")
    one, other = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))


def _cells(rows: DataFrame, groups: int, most: int) -> DataFrame:
    """A row for each cell a fingerprint lies in: (cell, fp, rep)."""
    cuts = [2 * (32 * k // groups) for k in range(groups + 1)]
    keys = []
    for at, chosen in enumerate(combinations(range(groups), groups - most)):
        mask = _signed(sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen))
        keys.append(F.xxhash64(F.lit(at), F.col("row").bitwiseAND(F.lit(mask).cast("bigint"))))
    return rows.withColumn("row", coordinates(F.col("fp"))).select(F.explode(F.array(*keys)).alias("cell"), "fp", "rep")


def pivots(count: int = 16) -> np.ndarray:
    """Spread-out reference fingerprints: XXH64 of their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(count)], np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


#: Says of positions (i, j) of rows which pairs may stay.
Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _forest(group: np.ndarray, fp: np.ndarray, most: int, check: Check | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of links that span the near pairs inside each group; groups stand together."""
    refs = pivots()
    first = _apart(fp, refs[0]).astype(np.int16)
    order = np.lexsort((first, group))
    g, x = group[order], fp[order]
    table = np.stack([_apart(x, r) for r in refs]).astype(np.int16)
    n, parent = len(x), np.arange(len(x))
    bounds = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    parts = np.diff(bounds).copy()  # how many unjoined parts each group still has
    live, out_i, out_j, gap = np.arange(n), [], [], 0

    def root(at: np.ndarray) -> np.ndarray:
        up = parent[at]
        while (parent[up] != up).any():
            up = parent[up]
        return up

    while len(live):
        gap += 1
        live = live[live + gap < n]
        other = live + gap
        near = (g[live] == g[other]) & (table[0, other] - table[0, live] <= most)
        live = live[near & (parts[of[live]] > 1)]
        if not len(live):
            break
        i, j = live, live + gap
        for row in table[1:]:
            keep = np.abs(row[i] - row[j]) <= most
            i, j = i[keep], j[keep]
        keep = _apart(x[i], x[j]) <= most
        i, j = i[keep], j[keep]
        if check and len(i):
            keep = check(order[i], order[j])
            i, j = i[keep], j[keep]
        if len(i):
            ri, rj = root(i), root(j)
            for a, b in zip(i[ri != rj].tolist(), j[ri != rj].tolist(), strict=True):
                ra, rb = a, b
                while parent[ra] != ra:
                    parent[ra] = ra = parent[parent[ra]]
                while parent[rb] != rb:
                    parent[rb] = rb = parent[parent[rb]]
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    parts[of[a]] -= 1
                    out_i.append(a)
                    out_j.append(b)
    return order[np.array(out_i, np.int64)], order[np.array(out_j, np.int64)]


def _all_pairs(group: np.ndarray, fp: np.ndarray, component: np.ndarray, most: int, check: Check | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all near pairs inside each group that are not of one component; groups stand together."""
    change = np.flatnonzero(np.diff(group, prepend=-1))
    mixed = np.logical_or.reduceat(component != np.repeat(component[change], np.diff(change, append=len(group))), change)
    live, out_i, out_j, gap = np.flatnonzero(np.repeat(mixed, np.diff(change, append=len(group)))), [], [], 0
    while len(live):
        gap += 1
        live = live[live + gap < len(group)]
        live = live[group[live] == group[live + gap]]
        keep = (component[live] != component[live + gap]) & (_apart(fp[live], fp[live + gap]) <= most)
        i, j = live[keep], live[keep] + gap
        if check and len(i):
            keep = check(i, j)
            i, j = i[keep], j[keep]
        out_i.append(i)
        out_j.append(j)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def link_batches(most: int, component: bool = False, checked: Callable[[pa.Table], Check] | None = None):
    """Links of cells that stand together: a spanning forest of the near pairs, or all near pairs of different components.

    ``checked`` makes a further check of pairs from the rows at hand.
    """

    def links(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(held).combine_chunks()
        cell, part = (t.column(k).to_numpy() for k in ("cell", "part"))
        change = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        end = len(cell) if last else int(change[-1]) if len(change) else 0
        if not end:
            return None, held
        group = np.zeros(end, np.int64)
        group[change[change < end]] = 1
        group, rep, fp = np.cumsum(group), t.column("rep").to_numpy()[:end], t.column("fp").to_numpy()[:end].view(np.uint64)
        check = checked(t) if checked else None
        i, j = _all_pairs(group, fp, t.column("component").to_numpy()[:end], most, check) if component else _forest(group, fp, most, check)
        made = pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])
        return made, t.slice(end).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 50_000:
                made, held = links(held, False)
                if made is not None:
                    yield made
        if held:
            yield links(held, True)[0]

    return run


def dealt(cells: DataFrame) -> DataFrame:
    """``cells(cell, fp, rep, ...)`` with a column part, rows of a (cell, part) together; cells over ``CELL`` rows as pairs of chunks."""
    columns = cells.columns
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    sizes = settle(sizes.select(F.col("cell").alias("big"), F.ceil(F.col("n") / (CELL // 2)).cast("int").alias("chunks")))
    cells = cells.withColumn("part", F.lit(0).cast("bigint"))
    if not sizes.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, mine) * F.lit(1 << 31).cast("bigint") + F.greatest(k, mine))
        cells = cells.join(sizes, F.col("cell") == F.col("big"), "left").select(
            *columns, F.explode(F.when(F.col("big").isNull(), F.array("part")).otherwise(pair)).alias("part")
        )
    return cells.repartition(F.col("cell"), F.col("part")).sortWithinPartitions("cell", "part")


def near_links(rows: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links between the ``rep`` of distinct fingerprints ``rows(fp, rep)`` that span all pairs within ``most`` bits."""
    cells = _cells(rows, groups_for(rows.count(), most), most)
    return dealt(cells).mapInArrow(lean(link_batches(most)), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    prints = settle(fingerprints(docs, id_col, text_col, words))
    distinct = settle(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(near_links(distinct, most))
    known = settle(distinct.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component")))
    return prints.join(known, F.col("fp") == F.col("of"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows with a null id stay."""
    groups = near_groups(docs, id_col, text_col, words, most)
    gone = settle(groups.where("component_id <> doc_id").select("doc_id").distinct())
    name = "_" + max(docs.columns, key=len)
    return docs.join(sent(gone.withColumnRenamed("doc_id", name)), F.col(id_col) == F.col(name), "left_anti")
