"""``VectorIndex``: build, search and change a collection of vectors.

Every read names a snapshot, a published manifest; writers make new tables and
publish the next manifest.  A change is a set of rows of its own, as large as the
batch and the lists that it touches; a manifest names its change sets in order, a
read merges them, and ``compact`` makes one of them.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import IndexConfig, QueryBudget, SearchOptions
from .errors import BY_CODE, ConfigMismatchError, DimensionMismatchError, IndexClosedError, InvalidArgumentError, InvalidVectorError, SnapshotExpiredError, StorageError, raise_typed
from .functions.quantize import bit_words, sbq_bits, thresholds, train_statistics
from .functions.vectors import is_valid_vector, label_set, normalised, prefix, valid_node
from .operators.shards import NODES, build_nodes, link_new, reachable, replayed, walk
from .plans.exact import exact_topk
from .plans.numbering import numbered, runs
from .plans.registry import REGISTRY, checked_quantizer, next_version
from .plans.replay import first_fault
from .plans.visibility import FEW_CHANGES, first_segment, merged_changes, node_reads, visible_nodes
from .sources.storage import FileStorage, Storage, destroy_uri, open_uri, parse_uri

LOG = "log_offset bigint, op string, node_id bigint, external_id bigint, full_vector array<float>, labels array<smallint>"
#: Rows of a change set.
CHANGES = f"{NODES}, kind string, epoch bigint"


@dataclass(frozen=True)
class Snapshot:
    """A published state; usable with the handle that gave it."""

    manifest: dict
    uid: str

    @property
    def version(self) -> int:
        return self.manifest["version"]


class VectorIndex:
    def __init__(self, storage: Storage, config: IndexConfig):
        self.storage, self.config, self.spark = storage, config, storage.spark
        self._lock = threading.Lock()
        self._closed = False
        self._quantizer: tuple = (None, None)
        self._cached: dict[int, DataFrame] = {}
        self._capacity = 0

    # -- handles ---------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, uri: str, config: IndexConfig) -> VectorIndex:
        storage = open_uri(spark, uri, create=True)
        storage.publish(cls._empty(config), 0)
        return cls(storage, config)

    @staticmethod
    def _empty(config: IndexConfig) -> dict:
        return {"config": config.to_dict(), "starts": {}, "segments": [], "changes": [], "epoch": 0, "quantizer": None, "max_node": 0, "applied": -1, "next_ref": 1}

    @classmethod
    def open(cls, spark: SparkSession, uri: str, config: IndexConfig | None = None) -> VectorIndex:
        storage = open_uri(spark, uri, create=False)
        stored = IndexConfig.from_dict(storage.latest()["config"])
        if config is not None and (other := stored.differences(config)):
            storage.close()
            raise ConfigMismatchError(f"different: {', '.join(other)}")
        return cls(storage, stored)

    @classmethod
    def open_or_create(cls, spark: SparkSession, uri: str, config: IndexConfig) -> VectorIndex:
        return cls.open(spark, uri, config) if cls.exists(spark, uri) else cls.create(spark, uri, config)

    @staticmethod
    def exists(spark: SparkSession, uri: str) -> bool:
        kind, name = parse_uri(uri)
        if kind == "memory":
            from .sources.storage import MemoryStorage

            return name in MemoryStorage._named
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{name}/manifest")
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))

    @staticmethod
    def destroy(spark: SparkSession, uri: str) -> None:
        destroy_uri(spark, uri)

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self.cache(0)
            self.storage.close()

    def __enter__(self) -> VectorIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _check_open(self) -> None:
        if self._closed:
            raise IndexClosedError(self.storage.uid)

    def snapshot(self) -> Snapshot:
        self._check_open()
        return Snapshot(self.storage.latest(), self.storage.uid)

    def _pinned(self, snapshot: Snapshot | None) -> dict:
        self._check_open()
        if snapshot is None:
            return self.storage.latest()
        if snapshot.uid != self.storage.uid:
            raise InvalidArgumentError("the snapshot belongs to another index")
        return snapshot.manifest

    # -- reading ---------------------------------------------------------

    def _changes(self, m: dict) -> DataFrame | None:
        """The rows of all change sets of a manifest; a later set has a larger ``set_pos``."""
        out = None
        for change in m["changes"]:
            try:
                part = self.storage.get(f"deltas/{change['ref']}", self.config.shards)
            except StorageError as e:
                raise SnapshotExpiredError(f"version {m['version']}") from e
            out = part if out is None else out.unionByName(part)
        return out

    def _delta(self, m: dict, part: str) -> DataFrame | None:
        changes = self._changes(m)
        return None if changes is None else dict(zip(("records", "rewrites", "tombstones"), merged_changes(changes), strict=True))[part]

    def nodes(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The node rows that a snapshot shows."""
        return self._nodes(self._pinned(snapshot))

    def cache(self, capacity: int = 1) -> None:
        """Keep the node rows of up to ``capacity`` snapshots from now on, the latest read last to go; 0 keeps none."""
        self._capacity = capacity
        while len(self._cached) > capacity:
            self._cached.pop(next(iter(self._cached))).unpersist()

    def _nodes(self, m: dict) -> DataFrame:
        """Cached rows are keyed by the snapshot's version, which names a frozen state."""
        if not self._capacity:
            return self._visible(m)
        if m["version"] not in self._cached:
            self._cached[m["version"]] = self._visible(m).persist()
            self.cache(self._capacity)
        return self._cached[m["version"]]

    def _visible(self, m: dict) -> DataFrame:
        base = None
        for pos, segment in enumerate(m["segments"]):
            try:
                part = self.storage.get(f"segments/{segment['ref']}", self.config.shards).withColumn("seg_pos", F.lit(pos))
            except StorageError as e:
                raise SnapshotExpiredError(f"version {m['version']}") from e
            base = part if base is None else base.unionByName(part)
        if base is None:
            base = self.spark.createDataFrame([], NODES)
        else:
            base = first_segment(base) if len(m["segments"]) > 1 else base.drop("seg_pos")
        changes = self._changes(m)
        if changes is None:
            return base
        records, rewrites, tombstones = merged_changes(changes)
        laid_out = records.repartition(self.storage.buckets(self.config.shards), "shard")  # as the segments are, which then stay where they are
        return visible_nodes(base, laid_out, rewrites, tombstones, m["epoch"], sum(c["count"] for c in m["changes"]) <= FEW_CHANGES)

    def read_nodes(self, node_ids: list[int], snapshot: Snapshot | None = None, budget: QueryBudget | None = None, columns: list[str] | None = None) -> DataFrame:
        """(pos, node_id, status, columns): a row for each requested id, in request order by ``pos``."""
        m = self._pinned(snapshot)
        if len(node_ids) > (budget or QueryBudget()).max_read_batch:
            from .errors import BudgetExceededError

            raise BudgetExceededError("max_read_batch")
        asked = self.spark.createDataFrame([(k, int(n)) for k, n in enumerate(node_ids)], "pos bigint, node_id bigint")
        seen = self._nodes(m).select("node_id", *(columns or ["external_id", "routing_plain", "routing_sbq", "labels", "neighbors"]))
        return node_reads(asked, seen, self._delta(m, "tombstones"), m["epoch"]).orderBy("pos")

    def read_full_vectors(self, node_ids: list[int], snapshot: Snapshot | None = None, budget: QueryBudget | None = None) -> DataFrame:
        if len(node_ids) * self.config.dimensions * 4 > (budget or QueryBudget()).max_full_vector_bytes:
            from .errors import BudgetExceededError

            raise BudgetExceededError("max_full_vector_bytes")
        return self.read_nodes(node_ids, snapshot, budget, ["external_id", "full_vector"])

    def _checked_queries(self, queries: DataFrame) -> DataFrame:
        v = F.col("vector")
        bad = queries.select(
            F.coalesce(F.sum((F.coalesce(F.size(v), F.lit(-1)) != self.config.dimensions).cast("int")), F.lit(0)).alias("size"),
            F.coalesce(F.sum((~is_valid_vector(v, self.config.dimensions)).cast("int")), F.lit(0)).alias("any"),
        ).first()
        if bad["size"]:
            raise DimensionMismatchError(f"{bad['size']} queries are not of {self.config.dimensions} dimensions")
        if bad["any"]:
            raise InvalidVectorError(f"{bad['any']} queries are not finite")
        return queries

    def search(
        self, queries: DataFrame, limit: int, search_list_size: int | None = None, rescore: bool = True, filter: list[int] | None = None, budget: QueryBudget | None = None, snapshot: Snapshot | None = None
    ) -> DataFrame:
        """(query_id, rank, node_id, external_id, distance) by a walk of each shard's graph.

        ``queries`` holds query_id, vector and optionally filter, a set of labels.
        """
        options = SearchOptions(limit, limit if search_list_size is None else search_list_size, None if filter is None else tuple(filter), rescore, budget or QueryBudget())
        m = self._pinned(snapshot)
        nodes = self._nodes(m)
        hits = walk(nodes, self._checked_queries(queries), self.config, m["starts"], self._statistics(m), options)
        return hits.withColumnRenamed("id", "node_id")

    def exact_search(self, queries: DataFrame, limit: int, filter: list[int] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The same by comparing all visible rows."""
        SearchOptions(limit, limit)
        asked = self._checked_queries(queries)
        if filter is not None:
            asked = asked.withColumn("filter", F.array(*[F.lit(x) for x in filter]).cast("array<smallint>"))
        nodes = self._nodes(self._pinned(snapshot))
        filter_col = "filter" if "filter" in asked.columns else None
        hits = exact_topk(nodes, asked, limit, self.config.distance, "node_id", "full_vector", "query_id", "vector", "labels", filter_col)
        return hits.withColumnRenamed("id", "node_id").join(nodes.select("node_id", "external_id"), "node_id").select("query_id", "rank", "node_id", "external_id", "distance")

    def invariants(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(rule, violations) of the visible graph."""
        n, most = self.nodes(snapshot), self.config.max_neighbors
        return n.select(
            F.explode(
                F.array(
                    F.struct(F.lit("too_many_neighbors").alias("rule"), (F.size("neighbors") > most).alias("bad")),
                    F.struct(F.lit("self_edge").alias("rule"), F.array_contains("neighbors", F.col("node_id")).alias("bad")),
                    F.struct(F.lit("repeated_neighbor").alias("rule"), (F.size(F.array_distinct("neighbors")) != F.size("neighbors")).alias("bad")),
                    F.struct(F.lit("invalid").alias("rule"), (~valid_node(F.col("node_id"), F.col("neighbors"), most)).alias("bad")),
                )
            ).alias("x")
        ).groupBy("x.rule").agg(F.sum(F.col("x.bad").cast("bigint")).alias("violations"))

    def reachable(self, snapshot: Snapshot | None = None, most: int | None = None) -> DataFrame:
        m = self._pinned(snapshot)
        return reachable(self._nodes(m), self.config, m["starts"], most or (1 << 62))

    # -- writing ---------------------------------------------------------

    def _checked(self, df: DataFrame) -> DataFrame:
        """Input rows (external_id, vector, labels), valid and without repeated ids."""
        labels = F.col("labels") if "labels" in df.columns else F.lit(None).cast("array<smallint>")
        rows = df.select(*[c for c in df.columns if c not in ("vector", "labels")], F.col("vector").cast("array<float>").alias("vector"), label_set(labels).alias("labels"))
        size = F.coalesce(F.size("vector"), F.lit(-1)) != self.config.dimensions
        bad = rows.select(
            *[F.coalesce(F.sum(x.cast("int")), F.lit(0)).alias(n) for n, x in (("size", size), ("any", ~is_valid_vector(F.col("vector"), self.config.dimensions)), ("labels", F.size("labels") > 0))]
        ).first()
        if bad["size"]:
            raise DimensionMismatchError(f"{bad['size']} rows are not of {self.config.dimensions} dimensions")
        if bad["any"]:
            raise InvalidVectorError(f"{bad['any']} rows are not finite")
        if bad["labels"] and not self.config.has_labels:
            raise InvalidArgumentError("rows have labels, the index has none")
        if "external_id" in rows.columns and not rows.groupBy("external_id").count().where("count > 1").isEmpty():
            raise InvalidArgumentError("an external id occurs twice")
        return rows.withColumn("vector", normalised(F.col("vector")).cast("array<float>")) if self.config.distance == "cosine" else rows

    def _statistics(self, m: dict) -> tuple | None:
        if self.config.quantizer is None or m["quantizer"] is None:
            return None
        if self._quantizer[0] != m["quantizer"]:  # the one in use is kept
            stored = self.storage.get(f"quantizers/{m['quantizer']}").first()
            checked_quantizer(stored, self.config.routing_dimensions, self.config.quantizer)
            self._quantizer = m["quantizer"], (stored["count"], list(stored["mean"]), list(stored["m2"]))
        return self._quantizer[1]

    def quantizers(self) -> DataFrame:
        """All stored quantizers: ref, scope, version, shape and statistics."""
        out = self.spark.createDataFrame([], REGISTRY)
        for name in self.storage.names("quantizers"):
            out = out.unionByName(self.storage.get(f"quantizers/{name}"))
        return out

    def _encoded(self, rows: DataFrame, stats: tuple | None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Node rows without edges from (node_id, external_id, vector, labels), and the columns to ``keep``."""
        c, head = self.config, prefix(F.col("vector"), self.config.routing_dimensions)
        plain, words = F.lit(None).cast("array<float>"), F.lit(None).cast("array<bigint>")
        if c.quantizer:
            count, mean, m2 = stats or (0, [], [])
            bits = sbq_bits(head, c.quantizer.bits, c.quantizer.use_mean, count, mean, m2)
            words = bit_words(bits, c.routing_dimensions * c.quantizer.bits)
        else:
            plain = head
        return rows.select(
            "node_id", F.col("external_id").cast("bigint").alias("external_id"), F.col("vector").alias("full_vector"), plain.alias("routing_plain"), words.alias("routing_sbq"), "labels",
            F.array().cast("array<bigint>").alias("neighbors"), ((F.col("node_id") - 1) % c.shards).cast("int").alias("shard"), *keep,
        )

    def _first_nodes(self, nodes: DataFrame) -> dict[str, dict]:
        """Entry nodes of each shard: its first node, and the first node of each label."""
        starts: dict[str, dict] = {}
        for r in nodes.groupBy("shard").agg(F.min("node_id").alias("n")).collect():
            starts[str(r.shard)] = {"default": r.n, "labeled": {}}
        if self.config.has_labels:
            for r in nodes.select("shard", "node_id", F.explode("labels").alias("label")).groupBy("shard", "label").agg(F.min("node_id").alias("n")).collect():
                starts[str(r.shard)]["labeled"][str(r.label)] = r.n
        return starts

    def bulk_build(self, df: DataFrame, order_by: str = "external_id") -> Snapshot:
        """Replace the index by the rows (external_id, vector[, labels]); node ids follow ``order_by``."""
        with self._lock:
            m = self._pinned(None)
            rows = self._checked(df)
            rows = numbered(rows, [order_by], 1)
            ref, stats, quantizer = m["next_ref"], None, None
            if self.config.quantizer:
                head = rows.select(prefix(F.col("vector"), self.config.routing_dimensions).alias("vector"))
                stats = thresholds(train_statistics(head)) if self.config.quantizer.use_mean else (0, [], [])
                if stats[0] or not self.config.quantizer.use_mean:
                    quantizer = ref
                    scope = "index"
                    version = next_version(self.quantizers(), scope)
                    made = [(ref, scope, version, self.config.routing_dimensions, self.config.quantizer.bits, self.config.quantizer.use_mean, *stats)]
                    self.storage.put(f"quantizers/{ref}", self.spark.createDataFrame(made, REGISTRY))
            nodes = self._encoded(rows, stats)
            self.storage.put(f"segments/{ref}", build_nodes(nodes, self.config), self.config.shards)
            stored = self.storage.get(f"segments/{ref}")
            count, last = stored.agg(F.count(F.lit(1)), F.max("node_id")).first()
            made = self._empty(self.config) | {
                "starts": self._first_nodes(stored), "segments": [{"ref": ref, "count": count}] if count else [], "quantizer": quantizer,
                "max_node": last or 0, "applied": m["applied"], "next_ref": ref + 1,
            }
            return Snapshot(self.storage.publish(made, m["version"]), self.storage.uid)

    def _unknown(self, rows: DataFrame, m: dict, key: str) -> None:
        """An error if an id of new rows is visible already."""
        if not rows.join(self._nodes(m).select(key), key, "left_semi").isEmpty():
            raise InvalidArgumentError(f"{key}: one exists already")

    def insert(self, df: DataFrame, order_by: str = "external_id") -> Snapshot:
        """Add rows (external_id, vector[, labels]), linked one after the other in each shard."""
        with self._lock:
            m = self._pinned(None)
            rows = self._checked(df)
            self._unknown(rows, m, "external_id")
            # the log may be ahead of the manifest, if a writer stopped between the two
            rows = numbered(rows, [order_by], max(m["max_node"], self.storage.state().get("max_node", 0)) + 1)
            log = rows.select(F.lit("insert").alias("op"), "node_id", F.col("external_id").cast("bigint").alias("external_id"), F.col("vector").alias("full_vector"), "labels")
            applied = self._append(log, m, ["node_id"])
            return self._insert(m, rows, applied)

    def delete(self, ids: DataFrame) -> Snapshot:
        """Remove the rows named by ``external_id`` or ``node_id``; an unknown id is an error."""
        with self._lock:
            m = self._pinned(None)
            key = "node_id" if "node_id" in ids.columns else "external_id"
            asked = ids.select(F.col(key).cast("bigint").alias(key)).distinct()
            found = asked.join(self._nodes(m).select("node_id", "external_id"), key).select("node_id", "external_id").persist()  # else each use looks the ids up in all rows
            try:
                if found.count() != asked.count():
                    raise InvalidArgumentError("an id to delete is not there")
                log = found.select(F.lit("delete").alias("op"), "node_id", "external_id", F.lit(None).cast("array<float>").alias("full_vector"), F.lit(None).cast("array<smallint>").alias("labels"))
                return self._delete(m, found.select("node_id"), self._append(log, m, ["node_id"]))
            finally:
                found.unpersist()

    def _append(self, log: DataFrame, m: dict, order: list[str]) -> int:
        """Write a batch of operations to the log; the offset of the last."""
        state = self.storage.state()
        first = state.get("next", 0)
        rows = numbered(log, order, first, "log_offset").select(*[x.split()[0] for x in LOG.split(", ")])
        self.storage.put(f"log/{first:020d}", rows)
        size, last = self.storage.get(f"log/{first:020d}").agg(F.count(F.lit(1)), F.max("node_id")).first()
        self.storage.set_state(state | {"next": first + size, "first": state.get("first", 0), "max_node": max(state.get("max_node", 0), last or 0)})
        return first + size - 1

    def _publish_changes(self, m: dict, rows: DataFrame, change: dict, chain: list[dict] | None = None) -> Snapshot:
        """Write a change set and publish it at the end of the chain (or of ``chain``)."""
        ref = m["next_ref"]
        self.storage.put(f"deltas/{ref}", rows.withColumn("set_pos", F.lit(ref).cast("bigint")), self.config.shards)
        count = self.storage.get(f"deltas/{ref}").count()
        chain = [*(m["changes"] if chain is None else chain), {"ref": ref, "count": count}]
        return Snapshot(self.storage.publish(m | change | {"changes": chain, "next_ref": ref + 1}, m["version"]), self.storage.uid)

    def _change_rows(self, records: DataFrame | None = None, rewrites: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame:
        """Rows of a change set; what a kind of row has no value for is null."""
        out = self.spark.createDataFrame([], CHANGES)
        shard = ((F.col("node_id") - 1) % self.config.shards).cast("int").alias("shard")
        for kind, df in (("record", records), ("rewrite", rewrites), ("tombstone", tombstones)):
            if df is not None:
                rows = df if "shard" in df.columns else df.select("*", shard)
                out = out.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        return out

    def _parts(self, m: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
        changes = self._changes(m)
        return merged_changes(self.spark.createDataFrame([], CHANGES + ", set_pos bigint") if changes is None else changes)

    def compact(self) -> Snapshot:
        """Make one change set of the chain; removed records and lists of removed rows go. What is visible stays the same."""
        with self._lock:
            m = self._pinned(None)
            if len(m["changes"]) < 2:
                return Snapshot(m, self.storage.uid)
            records, rewrites, tombstones = self._parts(m)
            dead = tombstones.select("node_id").distinct()
            live = [df.join(dead, "node_id", "left_anti") for df in (records, rewrites)]
            return self._publish_changes(m, self._change_rows(*live, tombstones), {}, [])

    def _insert(self, m: dict, rows: DataFrame, applied: int) -> Snapshot:
        stats = self._statistics(m)
        if self.config.quantizer and stats is None:
            raise StorageError("the quantizer is not trained: build first")
        fresh = self._encoded(rows, stats)
        touched = fresh.select("shard").distinct()  # at most one row a shard: the other shards are left alone
        touched = F.broadcast(touched) if self.config.shards <= FEW_CHANGES else touched
        near = self._nodes(m).join(touched, "shard", "left_semi")
        all_rows = near.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))
        changed = link_new(all_rows, self.config, m["starts"]).persist()
        linked = changed.where("is_new").select("node_id", F.col("neighbors").alias("_new"))
        hot = fresh.join(linked, "node_id", "left").withColumn("neighbors", F.coalesce("_new", "neighbors")).select(*fresh.columns)
        edges = changed.where("not is_new").select("node_id", "neighbors")
        starts = {k: {"default": v["default"], "labeled": dict(v["labeled"])} for k, v in m["starts"].items()}
        for shard, own in self._first_nodes(fresh).items():
            if starts.get(shard, {}).get("default") is None:
                starts[shard] = own
            else:
                for label, node in own["labeled"].items():
                    starts[shard]["labeled"].setdefault(label, node)
        last = fresh.agg(F.max("node_id")).first()[0]
        out = self._publish_changes(m, self._change_rows(hot, edges), {"starts": starts, "max_node": max(m["max_node"], last or 0), "applied": max(m["applied"], applied)})
        changed.unpersist()
        return out

    def _delete(self, m: dict, gone: DataFrame, applied: int) -> Snapshot:
        epoch = m["epoch"] + 1
        dead = gone.select("node_id", F.lit(epoch).cast("bigint").alias("epoch"))
        starts = self._repaired(m, gone)
        return self._publish_changes(m, self._change_rows(tombstones=dead), {"starts": starts, "epoch": epoch, "applied": max(m["applied"], applied)})

    def _entry_ids(self, m: dict) -> DataFrame:
        mine = {n for s in m["starts"].values() for n in [s["default"], *s["labeled"].values()] if n is not None}
        return self.spark.createDataFrame([(n,) for n in sorted(mine)], "node_id bigint")

    def _repaired(self, m: dict, gone: DataFrame) -> dict:
        """Entry nodes without the removed ones: the first of a breadth-first search that can stand in."""
        lost = {r.node_id for r in gone.join(self._entry_ids(m), "node_id", "left_semi").collect()}
        if not lost:
            return m["starts"]
        hurt = [int(k) for k, s in m["starts"].items() if lost & {s["default"], *s["labeled"].values()}]
        met = reachable(self._nodes(m).where(F.col("shard").isin(hurt)), self.config, m["starts"], QueryBudget().max_visited).persist()  # asked three times
        left = met.join(gone, "node_id", "left_anti")
        first = lambda *by: Window.partitionBy(*by).orderBy("pos")
        default = {str(r.shard): r.node_id for r in left.withColumn("k", F.row_number().over(first("shard"))).where("k = 1").collect()}
        labels = left.select("shard", "pos", "node_id", F.explode("labels").alias("label")).withColumn("k", F.row_number().over(first("shard", "label"))).where("k = 1").collect()
        cut = {str(r.shard) for r in met.where("truncated").select("shard").distinct().collect()}
        met.unpersist()
        found: dict[str, dict[str, int]] = {}
        for r in labels:
            found.setdefault(str(r.shard), {})[str(r.label)] = r.node_id
        out = {}
        for shard, s in m["starts"].items():
            if not lost & {s["default"], *s["labeled"].values()}:
                out[shard] = s
                continue
            labeled = dict(found.get(shard, {}))
            if shard in cut:  # what the search did not get to keeps its entry
                labeled = {x: n for x, n in s["labeled"].items() if n not in lost} | labeled
            out[shard] = {"default": default.get(shard), "labeled": labeled}
        return out

    # -- the log ---------------------------------------------------------

    def mutations(self, from_offset: int = 0) -> DataFrame:
        """Log rows from an offset on; an error if they were truncated."""
        self._check_open()
        if from_offset < self.storage.state().get("first", 0):
            raise StorageError(f"offset {from_offset} is no longer available")
        out = self.spark.createDataFrame([], LOG)
        for name in self.storage.names("log"):
            out = out.unionByName(self.storage.get(f"log/{name}"))
        return out.where(F.col("log_offset") >= from_offset)

    def replay(self, mutations: DataFrame) -> Snapshot:
        """Apply log rows in order without logging them again; those applied before are passed over.

        Rows are held to what ``insert`` and ``delete`` ask for (see ``first_fault``)
        and vectors normalised for cosine.  A run of one operation that has a row
        which breaks a rule is an error, and neither it nor what follows is applied;
        the runs before it stay.  All runs become one change set: each touched shard
        goes through its own part of the log in one task.
        """
        with self._lock:
            m = self._pinned(None)
            rows = runs(mutations.where(F.col("log_offset") > m["applied"]).select(*[x.split()[0] for x in LOG.split(", ")]), ["log_offset", "node_id"], "op").persist()
            visible = self._nodes(m).select("node_id", "external_id")
            fault = first_fault(rows, visible, self._delta(m, "tombstones"), self.config.dimensions, self.config.has_labels)
            good = rows if fault is None else rows.where(F.col("run") < fault.run)
            out = self._apply(m, good)
            rows.unpersist()
            if fault is not None:
                raise BY_CODE[fault.code](f"{fault.says} (offset {fault.log_offset})")
            return out

    def _apply(self, m: dict, log: DataFrame) -> Snapshot:
        """One change set of a log whose rows are numbered by ``run`` and break no rule."""
        ends = log.agg(F.max("log_offset").alias("last"), F.max(F.when(F.col("op") == "insert", F.col("node_id"))).alias("node"), F.max(F.when(F.col("op") == "delete", F.col("run"))).alias("cut")).first()
        if ends["last"] is None:
            return Snapshot(m, self.storage.uid)
        stats = self._statistics(m)
        if ends["node"] is not None and self.config.quantizer and stats is None:
            raise StorageError("the quantizer is not trained: build first")
        vector = F.col("full_vector").cast("array<float>")
        vector = normalised(vector).cast("array<float>") if self.config.distance == "cosine" else vector
        step = ("op", "run", "log_offset")
        new = log.where("op = 'insert'").select("node_id", "external_id", vector.alias("vector"), label_set(F.col("labels")).alias("labels"), *step)
        fresh = self._encoded(new, stats, step)
        gone = log.where("op = 'delete'").select("node_id", ((F.col("node_id") - 1) % self.config.shards).cast("int").alias("shard"), *step)
        # shards with new rows or a lost entry node; other shards need no task for rows that go
        lost = gone.join(self._entry_ids(m), "node_id", "left_semi")
        touched = fresh.select("shard").unionByName(lost.select("shard")).distinct()
        touched = F.broadcast(touched) if self.config.shards <= FEW_CHANGES else touched
        steps = fresh.unionByName(gone, allowMissingColumns=True).join(touched, "shard", "left_semi")
        near = self._nodes(m).join(touched, "shard", "left_semi")
        changed = replayed(near, steps, self.config, m["starts"], QueryBudget().max_visited).persist()
        starts = dict(m["starts"])
        for r in changed.where("kind in ('default', 'label')").orderBy(F.col("kind")).collect():  # a shard's default comes before its labels
            if r.kind == "default":
                starts[str(r.shard)] = {"default": r.node_id, "labeled": {}}
            else:
                starts[str(r.shard)]["labeled"][str(r.label)] = r.node_id
        lists = changed.where("kind = 'record'").select("node_id", F.col("neighbors").alias("_new"))
        hot = fresh.drop(*step, "neighbors").join(lists, "node_id").withColumnRenamed("_new", "neighbors")
        edges = changed.where("kind = 'rewrite'").select("node_id", "neighbors")
        # as if each run had been published by itself: removals count from the epoch on
        dead = gone.select("node_id", (F.lit(m["epoch"]) + F.floor(F.col("run") / 2) + 1).cast("bigint").alias("epoch"))
        epoch = m["epoch"] + (0 if ends["cut"] is None else ends["cut"] // 2 + 1)
        change = {"starts": starts, "epoch": epoch, "max_node": max(m["max_node"], ends["node"] or 0), "applied": max(m["applied"], ends["last"])}
        out = self._publish_changes(m, self._change_rows(hot, edges, dead), change)
        changed.unpersist()
        return out

    def checkpoint(self, offset: int) -> None:
        """Record that all before ``offset`` has been consumed."""
        state = self.storage.state()
        if not state.get("first", 0) <= offset <= state.get("next", 0):
            raise InvalidArgumentError(f"no such offset: {offset}")
        self.storage.set_state(state | {"checkpoint": offset})

    def checkpoint_offset(self) -> int | None:
        return self.storage.state().get("checkpoint")

    def truncate_before_checkpoint(self) -> None:
        """Drop log parts that end before the checkpoint; earlier offsets can no longer be read."""
        state = self.storage.state()
        at = state.get("checkpoint", 0)
        names = self.storage.names("log")
        for name, after in zip(names, [*names[1:], f"{state.get('next', 0):020d}"], strict=True):
            if int(after) <= at:
                self.storage.drop(f"log/{name}")
        self.storage.set_state(state | {"first": at})

    def recovered_high_water(self) -> int:
        """The largest node id ever given out, from the tables instead of the manifest."""
        m = self._pinned(None)
        found = [t.agg(F.max("node_id")).first()[0] for t in (self._visible(m | {"changes": []}), self._parts(m)[0], self._parts(m)[2])]
        return max((x for x in found if x is not None), default=0)

    def vacuum(self, retain: int = 2) -> None:
        """Make one change set of a chain of more than ``retain``, then drop all but the newest ``retain`` and the latest manifest's; older snapshots expire."""
        if len(self.storage.latest()["changes"]) > max(retain, 1):
            self.compact()
        current = {c["ref"] for c in self.storage.latest()["changes"]}
        refs = sorted(int(x) for x in self.storage.names("deltas"))
        for ref in refs[:-retain] if retain else refs:
            if ref not in current:
                self.storage.drop(f"deltas/{ref}")


def recall(hits: DataFrame, truth: DataFrame, k: int) -> float:
    """Share of the true (query_id, node_id) pairs that were found."""
    pairs = [df.select("query_id", "node_id").distinct() for df in (hits, truth)]
    return pairs[0].join(pairs[1], ["query_id", "node_id"]).count() / max(1, truth.select("query_id").distinct().count() * k)


def run_typed(df: DataFrame) -> list:
    """Collect, raising the typed error that a worker met."""
    try:
        return df.collect()
    except Exception as e:
        raise_typed(e)
        raise


__all__ = ["FileStorage", "Snapshot", "VectorIndex", "numbered", "recall", "run_typed"]
