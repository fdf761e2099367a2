"""Exact nearest neighbours, and two-phase search with rescoring.

The queries travel, the vectors stay: blocks of at most ``QUERY_BLOCK`` queries
are broadcast, every task scores its vectors against a block by matrix products
and keeps the best k of each query, and a window ranks the few rows that all tasks
leave.  A product loses digits of squared distances between vectors that are far
from the origin, so it only picks 2k rows, of which the distances are then taken
coordinate by coordinate.  A query set of any size is worked off block by
block, so what is broadcast has a fixed bound, and the vectors never shuffle.

Defined cases: rows and queries without a vector or an id have no hits; a row meets only queries of its own width; rows
and queries with numbers that are not finite have no hits; ties go to the smaller id; without queries there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, labels_match

QUERY_BLOCK = 4096
#: Numbers that a task holds at a time while it scores.
STEP = 1 << 22
HITS = "query_id bigint, id bigint, distance double"


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """The rows of a list column of one width as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows and rows of unit length up to rounding stay as they are."""
    squares = (m * m).sum(1)
    eps = 2.0**-23
    keep = (squares < eps) | (np.abs(squares - 1) <= eps * m.shape[1])
    return m / np.where(keep, 1.0, np.sqrt(squares))[:, None]


def score_matrix(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of all queries (rows of the result) to all rows."""
    if metric == "hamming":
        out = np.zeros((len(queries), len(rows)))
        for k in range(queries.shape[1]):
            out += np.bitwise_count(queries[:, k : k + 1] ^ rows[:, k])
        return out
    products = queries @ rows.T
    if metric == "l2":
        return np.maximum((queries * queries).sum(1)[:, None] + (rows * rows).sum(1) - 2 * products, 0.0)
    return np.maximum(1 - products, 0.0) if metric == "cosine" else -products


def pair_distances(metric: str, queries: np.ndarray, at: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of pairs (query ``at``, row ``to``), coordinate by coordinate."""
    out, step = np.zeros(len(at)), max(1, STEP // max(1, queries.shape[1]))
    for k in range(0, len(at), step):
        q, r = queries[at[k : k + step]], rows[to[k : k + step]]
        if metric == "hamming":
            out[k : k + step] = np.bitwise_count(q ^ r).sum(1)
        elif metric == "l2":
            out[k : k + step] = ((q - r) ** 2).sum(1)
        else:
            products = (q * r).sum(1)
            out[k : k + step] = np.maximum(1 - products, 0.0) if metric == "cosine" else -products
    return out


def _hot(sets: pa.Array | list, names: np.ndarray) -> np.ndarray:
    """A line for each label set: which of ``names`` it holds."""
    sets = sets if isinstance(sets, pa.Array) else pa.array(sets, pa.list_(pa.int64()))
    out = np.zeros((len(sets), len(names)), np.float32)
    line = np.repeat(np.arange(len(sets)), pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False))
    held = sets.flatten().to_numpy(zero_copy_only=False)
    known = np.isin(held, names)
    out[line[known], np.searchsorted(names, held[known])] = 1
    return out


def _topk_batches(metric: str, k: int, shared, filtered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted = shared.value
        best = [np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)]
        names = np.array(sorted(set().union(*wanted)), np.int64) if filtered else None
        asks = _hot([sorted(w) for w in wanted], names) if filtered else None
        for b in batches:
            if not b.num_rows:
                continue
            rows = matrix(b.column(1), np.int64).view(np.uint64) if metric == "hamming" else matrix(b.column(1))
            if metric == "cosine":
                rows = unit(rows)
            order = np.argsort(b.column(0).to_numpy(), kind="stable")
            rows, own = rows[order], b.column(0).to_numpy()[order]
            held = _hot(b.column(2), names)[order] if filtered else None
            made = []
            step = max(1, STEP // len(own))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                d = score_matrix(metric, q[part] - q.mean(0), rows - q.mean(0)) if metric == "l2" else score_matrix(metric, q[part], rows)
                if filtered:
                    barred = (asks[part].sum(1) > 0)[:, None] & (asks[part] @ held.T == 0)
                    d[barred] = np.inf
                most = min(2 * k + 8 if metric == "l2" else k, d.shape[1])
                if most < d.shape[1]:
                    border = np.partition(d, most - 1, axis=1)[:, most - 1]
                    line, to = np.nonzero(d <= border[:, None])  # ties at the border are kept
                else:
                    line, to = np.nonzero(np.isfinite(d))
                keep = np.isfinite(d[line, to])
                line, to = line[keep], to[keep]
                made.append((line + at, own[to], pair_distances(metric, q, line + at, rows, to) if metric == "l2" else d[line, to]))
            line, own, d = (np.concatenate(x) for x in zip(*made, strict=True))
            line = np.concatenate((np.repeat(np.arange(len(ids)), best[0].shape[1]), line))
            own, d = np.concatenate((best[1].ravel(), own)), np.concatenate((best[0].ravel(), d))
            order = np.lexsort((own, d, line))
            line, own, d = line[order], own[order], d[order]
            rank = np.arange(len(line)) - np.searchsorted(line, line)
            keep = rank < k
            best = [np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)]
            best[0][line[keep], rank[keep]], best[1][line[keep], rank[keep]] = d[keep], own[keep]
        keep = np.isfinite(best[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(1))), pa.array(best[1][keep]), pa.array(best[0][keep])], names=["query_id", "id", "distance"])

    return run


def query_blocks(queries: DataFrame, id_col: str, vector_col: str, filter_col: str | None) -> Iterator[tuple[list, list, list]]:
    held: tuple[list, list, list] = ([], [], [])
    queries = queries.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    columns = [F.col(id_col).cast("bigint").alias("i"), F.col(vector_col).alias("v"), (F.col(filter_col) if filter_col else F.lit(None)).alias("f")]
    for r in queries.select(*columns).toLocalIterator():
        for part, x in zip(held, (r.i, r.v, set(r.f or ())), strict=True):
            part.append(x)
        if len(held[0]) == QUERY_BLOCK:
            yield held
            held = ([], [], [])
    if held[0]:
        yield held


def ranked(hits: DataFrame, k: int, order: Column | str = "distance") -> DataFrame:
    """(query_id, rank, id, other columns, distance): the k least of each query by (distance, id)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    rest = [c for c in hits.columns if c not in ("query_id", "id", "distance")]
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", *rest, "distance")


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", query_id_col: str = "vec_id",
    query_col: str = "embedding", labels_col: str | None = None, filter_col: str | None = None,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query, ties by id.

    ``metric`` is l2 (squared), cosine, inner_product (negative) or hamming over
    arrays of words.  With ``filter_col`` a row counts only if its labels overlap
    the query's filter; an empty filter counts all rows.
    """
    filtered = bool(labels_col and filter_col)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), *([F.col(labels_col).alias("l")] if filtered else [])).where("id is not null and v is not null")
    found = None
    for block in query_blocks(queries, query_id_col, query_col, filter_col if filtered else None):
        for width in sorted({len(v) for v in block[1]}):  # one, as a rule
            ids, vs, wanted = zip(*(x for x in zip(*block, strict=True) if len(x[1]) == width), strict=True)
            q = np.array(vs, np.int64).view(np.uint64) if metric == "hamming" else np.array(vs, np.float64)
            fit = np.flatnonzero(np.isfinite(q).all(1)) if metric != "hamming" else np.arange(len(q))
            if not len(fit) or not width:
                continue
            q, ids, wanted = q[fit], np.array(ids, np.int64)[fit], [wanted[x] for x in fit]
            shared = vectors.sparkSession.sparkContext.broadcast((ids, unit(q) if metric == "cosine" else q, wanted))
            part = rows.where(F.size("v") == width).mapInArrow(_topk_batches(metric, k, shared, filtered), HITS)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], HITS)
    return ranked(found, k)


def rescore(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str, query_id_col: str, query_col: str) -> DataFrame:
    """Candidates (query_id, id) with exact distances on full vectors, the k best of each query."""
    full = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(query_id_col).cast("bigint").alias("query_id"), F.col(query_col).alias("q"))
    pairs = candidates.select("query_id", "id").join(full, "id").join(asked, "query_id")
    return ranked(pairs.select("query_id", "id", distance(metric, F.col("q"), F.col("v")).alias("distance")), k)


def two_phase_topk(
    routing: DataFrame, vectors: DataFrame, routing_queries: DataFrame, queries: DataFrame, k: int, candidates: int, routing_metric: str, metric: str,
    id_col: str = "vec_id", routing_col: str = "routing", vector_col: str = "embedding",
) -> DataFrame:
    """The ``candidates`` best by a cheap routing distance, then the k best of these exactly.

    Only the survivors meet the full vectors.
    """
    cheap = exact_topk(routing, routing_queries, candidates, routing_metric, id_col, routing_col, id_col, routing_col)
    return rescore(cheap, vectors, queries, k, metric, id_col, vector_col, id_col, vector_col)


__all__ = ["exact_topk", "labels_match", "ranked", "rescore", "score_matrix", "two_phase_topk"]
