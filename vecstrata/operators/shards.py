"""Graph operators over DataFrames: one task for each shard of the node table.

A shard is a graph of its own of bounded size; more data means more shards, not
larger ones.  Searches send blocks of queries to all shards and rank the hits
of all of them; nothing but the queries is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig, SearchOptions
from ..functions.quantize import encode_matrix
from ..plans.exact import matrix, query_blocks, ranked, unit
from ..plans.numbering import numbered
from .graph import Graph

NODES = "node_id bigint, external_id bigint, full_vector array<float>, routing_plain array<float>, routing_sbq array<bigint>, labels array<smallint>, neighbors array<bigint>, shard int"
HITS = "query_id bigint, id bigint, external_id bigint, distance double"


def graph_of(table: pa.Table, config: IndexConfig) -> Graph:
    """The graph of a shard's node rows."""
    table = table.sort_by("node_id").combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    full = matrix(column("full_vector"))
    if config.quantizer:
        routing = matrix(column("routing_sbq"), np.int64).view(np.uint64)
    else:
        routing = full[:, : config.routing_dimensions]
    labels = [frozenset(x or ()) for x in column("labels").to_pylist()]
    neighbors = [list(x or ()) for x in column("neighbors").to_pylist()]
    return Graph(config, column("node_id").to_numpy(), column("external_id").to_numpy(), routing, full, labels, neighbors)


def build_nodes(nodes: DataFrame, config: IndexConfig) -> DataFrame:
    """The node rows with the neighbour lists of each shard's wired graph; one shuffle, by shard."""

    def build(key, table):
        table = table.sort_by("node_id").combine_chunks()
        graph = graph_of(table, config)
        graph.build()
        lists = [graph.ids[x].tolist() if len(x) else [] for x in graph.neighbors]
        at = table.schema.get_field_index("neighbors")
        return table.set_column(at, "neighbors", pa.array(lists, pa.list_(pa.int64())))

    return nodes.groupBy("shard").applyInArrow(build, nodes.schema)


def starts_for(starts: dict, wanted) -> list[int]:
    """Entry nodes: the default one, with a filter also those of its labels; sorted, without repeats."""
    default, labeled = starts.get("default"), starts.get("labeled", {})
    found = {labeled[str(x)] for x in wanted if str(x) in labeled}
    if default is not None:
        found.add(default)
    return sorted(found)


def encode_queries(q: np.ndarray, config: IndexConfig, stats: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(routing form, full form) of queries."""
    full = unit(q) if config.distance == "cosine" else q
    routing = full[:, : config.routing_dimensions]
    if config.quantizer:
        count, mean, m2 = stats or (0, np.zeros(config.routing_dimensions), np.zeros(config.routing_dimensions))
        routing = encode_matrix(routing, config.quantizer.bits, config.quantizer.use_mean, count, np.array(mean), np.array(m2))
    return routing, full


def walk(nodes: DataFrame, queries: DataFrame, config: IndexConfig, starts: dict[str, dict], stats: tuple | None, options: SearchOptions) -> DataFrame:
    """(query_id, rank, id, external_id, distance) with node ids; ``queries(query_id, vector[, filter])``, ``starts`` by shard."""
    found = None
    filter_col = "filter" if "filter" in queries.columns else None
    for ids, vectors, wanted in query_blocks(queries, "query_id", "vector", filter_col):
        routing, full = encode_queries(np.array(vectors, np.float64), config, stats)
        shared = nodes.sparkSession.sparkContext.broadcast((ids, routing, full, wanted))
        part = nodes.groupBy("shard").applyInArrow(_walk_shard(shared, config, starts, options), HITS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = nodes.sparkSession.createDataFrame([], HITS)
    return ranked(found, options.limit)


class Nearest:
    """The ``k`` least distances that a task has found for each query so far: what is farther than all of them need not be sent."""

    def __init__(self, queries: int, k: int):
        self.held = np.full((queries, k), np.inf)

    @property
    def bound(self) -> np.ndarray:
        return self.held[:, -1]

    def add(self, line: np.ndarray, dist: np.ndarray) -> None:
        """Take in distances that are sorted by query, ``k`` of each at most."""
        if len(line):
            mine, of = np.unique(line, return_inverse=True)
            new = np.full((len(mine), self.held.shape[1]), np.inf)
            new[of, np.arange(len(line)) - np.searchsorted(line, line)] = dist
            self.held[mine] = np.sort(np.hstack((self.held[mine], new)), axis=1)[:, : self.held.shape[1]]


def _walk_shard(shared, config: IndexConfig, starts: dict[str, dict], options: SearchOptions) -> Callable:
    nearest: Nearest | None = None  # each task has its own, for all the shards that it walks

    def run(key, table):
        nonlocal nearest
        graph = graph_of(table, config)
        mine = starts.get(str(key[0].as_py()), {})
        ids, routing, full, filters = shared.value
        places: dict[frozenset, int] = {}
        of = np.array([places.setdefault(frozenset(w or options.filter or ()), len(places)) for w in filters], np.int64)
        wanted = list(places)
        groups = [(starts_for(mine, w), w) for w in wanted]
        limit, width, budget = options.limit, options.search_list_size, options.budget
        if graph.fits_budget(width, budget, routing[0].nbytes):
            nearest = nearest or Nearest(len(ids), limit)
            line, row, dist = graph.hits(routing, full, groups, of, limit, width, options.rescore, nearest.bound)
            nearest.add(line, dist)
        else:
            found = [graph.search(routing[k], full[k], groups[g][0], limit, width, wanted[g], options.rescore, budget) for k, g in enumerate(of)]
            line = np.repeat(np.arange(len(ids)), [len(x) for x in found])
            row, dist = np.array([r for x in found for _, r in x], np.int64), np.array([d for x in found for d, _ in x], np.float64)
        columns = (np.array(ids, np.int64)[line], graph.ids[row], graph.external[row], dist)
        return pa.table({n.split()[0]: pa.array(c) for n, c in zip(HITS.split(", "), columns, strict=True)})

    return run


def entries(starts: dict[str, dict], shard: int) -> dict:
    """A shard's entry nodes, to be changed by the caller."""
    mine = starts.get(str(shard), {})
    return {"default": mine.get("default"), "labeled": dict(mine.get("labeled", {}))}


def link(graph: Graph, node: int, mine: dict, changed: dict[int, list[int]]) -> None:
    """Link a row that ``graph.at`` shows; brings the entry nodes and the lists by node that changed up to date."""
    labels = graph.labels[graph.at[node]]
    if mine["default"] in graph.at and mine["default"] != node:
        own, touched = graph.insert(node, starts_for(mine, ()), starts_for(mine, labels))
        changed[node] = own
        for x in touched:
            changed[x] = graph.neighbors[graph.at[x]]
    else:  # the first row, or no entry left: the new row becomes it
        mine["default"], mine["labeled"], changed[node] = node, {}, []
    for x in labels:
        mine["labeled"].setdefault(str(x), node)


def unlinked(graph: Graph, gone: set[int], mine: dict, most: int) -> dict:
    """The entry nodes without removed rows: the first that a breadth-first search meets stand in for those lost."""
    old = {mine["default"], *mine["labeled"].values()} - {None}
    if not old & gone:
        return mine
    order, cut = graph.breadth_first(sorted(old), most)
    left = [k for k in order if int(graph.ids[k]) not in gone]
    labeled: dict[str, int] = {}
    for k in left:
        for x in graph.labels[k]:
            labeled.setdefault(str(x), int(graph.ids[k]))
    if cut:  # what the search did not get to keeps its entry
        labeled = {x: n for x, n in mine["labeled"].items() if n not in gone} | labeled
    return {"default": int(graph.ids[left[0]]) if left else None, "labeled": labeled}


def link_new(nodes: DataFrame, config: IndexConfig, starts: dict[str, dict]) -> DataFrame:
    """(node_id, neighbors, is_new) of rows that were linked or whose lists changed.

    ``nodes`` are the visible rows and the new ones, flagged ``is_new``.  Within
    a shard new rows are linked one after the other in order of node id, so
    later ones see earlier ones.
    """

    def run(key, table):
        table = table.sort_by("node_id").combine_chunks()
        fresh = set(table.filter(table.column("is_new")).column("node_id").to_pylist())
        graph, changed = graph_of(table, config), {}
        mine = entries(starts, key[0].as_py())
        waiting = {n: graph.at.pop(n) for n in fresh}
        for node in sorted(fresh):
            graph.at[node] = waiting[node]
            link(graph, node, mine, changed)
        names = sorted(changed)
        return pa.table(
            {
                "node_id": pa.array(names, pa.int64()),
                "neighbors": pa.array([changed[n] for n in names], pa.list_(pa.int64())),
                "is_new": pa.array([n in fresh for n in names], pa.bool_()),
            }
        )

    return nodes.groupBy("shard").applyInArrow(run, "node_id bigint, neighbors array<bigint>, is_new boolean")


def replayed(nodes: DataFrame, steps: DataFrame, config: IndexConfig, starts: dict[str, dict], most: int) -> DataFrame:
    """What a log changes in its shards: (shard, kind, node_id, neighbors, label).

    ``nodes`` are the visible rows of the shards and ``steps`` the log's operations
    on them: node rows with ``op`` (insert or delete), ``run`` and ``log_offset``.  A
    task goes through its shard's steps in order, the deletes of a run together.
    Kinds are record and rewrite (the last neighbours of a new or an old row that is
    still there) and default and label (the entry nodes after the last step).
    """

    def run(key, table):
        shard = key[0].as_py()
        steps = table.filter(pc.is_valid(table.column("op"))).sort_by([("run", "ascending"), ("log_offset", "ascending")])
        todo = list(zip(*(steps.column(c).to_pylist() for c in ("run", "op", "node_id")), strict=True))
        graph, changed, mine = graph_of(table.filter(pc.fill_null(pc.not_equal(table.column("op"), "delete"), True)), config), {}, entries(starts, shard)
        fresh = {n for _, op, n in todo if op == "insert"}
        waiting = {n: graph.at.pop(n) for n in fresh}
        for (_, op), part in groupby(todo, key=lambda x: x[:2]):
            ids = [n for *_, n in part]
            if op == "insert":
                for node in ids:
                    graph.at[node] = waiting[node]
                    link(graph, node, mine, changed)
            else:
                mine = unlinked(graph, set(ids), mine, most)
                for node in ids:
                    graph.at.pop(node)
                    changed.pop(node, None)
        out = [("record" if n in fresh else "rewrite", n, changed[n], None) for n in sorted(changed)]
        out += [("default", mine["default"], None, None), *(("label", n, None, int(x)) for x, n in mine["labeled"].items())]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.table([pa.array([shard] * len(out), pa.int32()), *columns], names=["shard", "kind", "node_id", "neighbors", "label"])

    rows = nodes.unionByName(steps, allowMissingColumns=True)
    return rows.groupBy("shard").applyInArrow(run, "shard int, kind string, node_id bigint, neighbors array<bigint>, label int")


def reachable(nodes: DataFrame, config: IndexConfig, starts: dict[str, dict], most: int) -> DataFrame:
    """(shard, pos, node_id, labels, truncated): rows met by a bounded breadth-first search from each shard's entries."""

    def run(key, table):
        graph = graph_of(table, config)
        mine = starts.get(str(key[0].as_py()), {})
        order, cut = graph.breadth_first(sorted({*mine.get("labeled", {}).values(), *([mine["default"]] if mine.get("default") is not None else [])}), most)
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * len(order), pa.int32()),
                "pos": pa.array(range(len(order)), pa.int64()),
                "node_id": pa.array([int(graph.ids[k]) for k in order], pa.int64()),
                "labels": pa.array([sorted(graph.labels[k]) for k in order], pa.list_(pa.int16())),
                "truncated": pa.array([cut] * len(order), pa.bool_()),
            }
        )

    return nodes.groupBy("shard").applyInArrow(run, "shard int, pos bigint, node_id bigint, labels array<smallint>, truncated boolean")


def reachable_by_joins(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node_id): all nodes reachable over ``edges(node_id, neighbors)``, a join for each level of the frontier."""
    spark = edges.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        raise ValueError("set spark.checkpoint.dir: the frontier is written after each level")
    links = edges.select("node_id", F.explode("neighbors").alias("to"))
    seen = frontier = starts.select("node_id").distinct().checkpoint()
    while not frontier.isEmpty():
        frontier = frontier.join(links, "node_id").select(F.col("to").alias("node_id")).distinct().join(seen, "node_id", "left_anti").checkpoint()
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def reachable_bounded(nodes: DataFrame, starts: DataFrame, max_visited: int, max_candidates: int) -> DataFrame:
    """(node_id, rank, level, present, truncated): the nodes that a bounded breadth-first search visits, a join for each level.

    ``rank`` is the place in a first-in-first-out queue: entries in order of id, then
    neighbours in the order of (place of the node that names them first, place in its
    list).  At most ``max_visited`` places are visited, ids without a row among them,
    and at most ``max_candidates`` are queued beyond the entries; ``truncated`` says
    that either limit left something out.  Ranks come from sorted ranges and their
    sizes, so no task sees a whole level.
    """
    spark = nodes.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        raise ValueError("set spark.checkpoint.dir: the frontier is written after each level")
    links = nodes.select("node_id", F.posexplode("neighbors").alias("place", "to"))
    frontier = numbered(starts.select("node_id").distinct(), ["node_id"], 0, "rank").withColumn("level", F.lit(0)).checkpoint()
    queued, met, level = frontier, None, 0
    size = total = frontier.count()
    visited, truncated = 0, False
    while size:
        room = max_visited - visited
        if room <= 0:
            truncated = True
            break
        taken = frontier.where(F.col("rank") < visited + room) if size > room else frontier
        met = taken if met is None else met.unionByName(taken)
        visited += min(size, room)
        named = taken.join(links, "node_id").groupBy(F.col("to").alias("node_id")).agg(F.min(F.struct("rank", "place")).alias("by"))
        fresh = named.join(queued.select("node_id"), "node_id", "left_anti").select("node_id", F.col("by.rank").alias("of"), F.col("by.place").alias("place"))
        level += 1
        new = numbered(fresh, ["of", "place"], total, "rank").select("node_id", "rank", F.lit(level).alias("level"))
        space = max(0, max_candidates - total)
        found = new.count()
        truncated |= found > space or size > room
        new = new.where(F.col("rank") < total + space).checkpoint()
        if size > room:
            break
        queued, frontier, size = queued.unionByName(new), new, min(found, space)
        total += size
    if met is None:
        met = frontier.where(F.lit(False))
    here = nodes.select("node_id", F.lit(True).alias("present"))
    return met.join(here, "node_id", "left").select("node_id", "rank", F.col("level").cast("bigint").alias("level"), F.coalesce("present", F.lit(False)).alias("present"), F.lit(truncated).alias("truncated"))
