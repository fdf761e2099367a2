"""The catalogue of queries over ``embeddings`` and the SQL that gives the same rows.

Searches are asked for every row whose id is divisible by 20, against all rows.
Versioned tables are derived from
``embeddings`` by predicates, the same on both sides (see FIXTURES.md, part C).
Distances are rounded to six decimals: the engine and the SQL add up doubles in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import IndexConfig, Quantizer, QueryBudget, SearchOptions
from .errors import VectorIndexError
from .functions import contains_intersection, cosine_norm, is_valid_vector, label_set, normalised, prefix, sbq_bits, sbq_ones, train_statistics
from .functions.quantize import bit_words, thresholds
from .index import VectorIndex
from .operators.shards import reachable_bounded, reachable_by_joins
from .plans import exact_topk, fold_mutations, node_reads, rescore, two_phase_topk, visible_nodes
from .plans.registry import REGISTRY, latest, ones_by_scope, registered, train_scopes

K = 10
#: The rows that searches ask for.
EVERY_20TH = "vec_id % 20 = 0"
BUILD = {"max_neighbors": 24, "build_search_list_size": 64}


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def _asked(e: DataFrame) -> DataFrame:
    return e.where(EVERY_20TH)


def _shown(hits: DataFrame, id_col: str = "id") -> DataFrame:
    return hits.select("query_id", "rank", F.col(id_col).alias("vec_id"), F.round("distance", 6).alias("distance"))


def _exact(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _embeddings(spark, sf_dir)
        return _shown(exact_topk(e, _asked(e), K, metric))

    return run


def _filtered(wanted: tuple[int, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _embeddings(spark, sf_dir).withColumn("labels", F.array("label"))
        q = _asked(e).withColumn("filter", F.array(*[F.lit(x) for x in wanted]).cast("array<int>"))
        return _shown(exact_topk(e, q, K, "l2", labels_col="labels", filter_col="filter"))

    return run


def topk_prefix_norescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir).withColumn("routing", prefix(F.col("embedding"), 16))
    return _shown(exact_topk(e, _asked(e), K, "l2", vector_col="routing", query_col="routing"))


def topk_prefix_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    head = e.select("vec_id", prefix(F.col("embedding"), 16).alias("routing"))
    return _shown(two_phase_topk(head, e, _asked(head), _asked(e), K, 64, "l2", "l2"))


def cosine_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)).alias("v"))
    after = normalised(F.col("v"))
    length = F.sqrt(F.aggregate(after, F.lit(0.0), lambda a, x: a + x * x))
    return scaled.select("vec_id", F.round(F.coalesce(cosine_norm(F.col("v")), F.lit(1.0)), 6).alias("norm"), F.round(length, 6).alias("after"))


def sbq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = train_statistics(_embeddings(spark, sf_dir), "embedding")
    return stats.select(F.col("dim").cast("bigint").alias("dim"), "count", F.round("mean", 6).alias("mean"), F.round("m2", 6).alias("m2"))


def _bits(e: DataFrame, bits: int, use_mean: bool, out: str) -> DataFrame:
    count, mean, m2 = thresholds(train_statistics(e, "embedding")) if use_mean else (0, [], [])
    v = F.col("embedding")
    code = sbq_ones(v, bits, count, mean, m2) if bits > 1 else sbq_bits(v, 1, use_mean, count, mean, m2)
    return e.select("vec_id", F.posexplode(code).alias("dim", "x")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("bigint").alias(out))


def _words(e: DataFrame) -> DataFrame:
    count, mean, m2 = thresholds(train_statistics(e, "embedding"))
    return e.select("vec_id", bit_words(sbq_bits(F.col("embedding"), 1, True, count, mean, m2), len(mean)).alias("routing"))


def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(_embeddings(spark, sf_dir))
    return _shown(exact_topk(w, _asked(w), K, "hamming", vector_col="routing", query_col="routing"))


def sbq_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    w = _words(e)
    return _shown(two_phase_topk(w, e, _asked(w), _asked(e), K, 100, "hamming", "l2"))


def sbq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall@10 by how many candidates the codes pass on."""
    e = _embeddings(spark, sf_dir)
    w = _words(e)
    truth = exact_topk(e, _asked(e), K).select("query_id", "id")
    cheap = exact_topk(w, _asked(w), 400, "hamming", vector_col="routing", query_col="routing")
    asked, found = _asked(e).count(), None
    for size in (50, 100, 200, 400):
        hits = rescore(cheap.where(F.col("rank") <= size), e, _asked(e), K, "l2", "vec_id", "embedding", "vec_id", "embedding")
        part = truth.join(hits, ["query_id", "id"]).agg(F.round(F.count(F.lit(1)) / (K * asked), 6).alias("recall")).select(F.lit(size).cast("bigint").alias("list_size"), "recall")
        found = part if found is None else found.unionByName(part)
    return found


# -- versioned tables ------------------------------------------------------


def _nodes(e: DataFrame) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return e.select((F.col("vec_id") + 1).alias("node_id"), F.col("vec_id").alias("external_id"), F.col("embedding").cast("array<double>").alias("v"), none.alias("neighbors"))


def _hot(e: DataFrame) -> DataFrame:
    n = _nodes(e.where("vec_id % 7 = 0"))
    return n.select("node_id", (F.col("external_id") + 100000).alias("external_id"), F.transform("v", lambda x: -x).alias("v"), "neighbors")


def _rewrites(e: DataFrame) -> DataFrame:
    n = e.agg(F.count(F.lit(1)).alias("n"))
    ids = F.array((F.col("vec_id") + 1) % F.col("n") + 1, (F.col("vec_id") + 2) % F.col("n") + 1)
    return e.where("vec_id % 5 = 0").join(F.broadcast(n)).select((F.col("vec_id") + 1).alias("node_id"), ids.alias("neighbors"))


def _tombstones(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 10 = 0").select((F.col("vec_id") + 1).alias("node_id"), F.expr("vec_id div 10 + 1").alias("epoch"))


EPOCH = 20


def _visible(e: DataFrame, epoch: int = EPOCH) -> DataFrame:
    return visible_nodes(_nodes(e), _hot(e), _rewrites(e), _tombstones(e), epoch)


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _visible(_embeddings(spark, sf_dir))
    return v.select("node_id", "external_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"), F.round(F.col("v")[0], 6).alias("v0"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of every node id of the table, and of 40 ids past it."""
    e = _embeddings(spark, sf_dir)
    asked = spark.range(0, e.count() + 40).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("node_id"))
    return node_reads(asked, _visible(e), _tombstones(e), EPOCH).select("pos", "node_id", "status", "external_id")


def _topk_visible(e: DataFrame, rows: DataFrame) -> DataFrame:
    q = _asked(e).select("vec_id", F.col("embedding").alias("q"))
    return exact_topk(rows, q, K, "l2", "node_id", "v", "vec_id", "q").select("query_id", "rank", F.col("id").alias("node_id"), F.round("distance", 6).alias("distance"))


def topk_after_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _topk_visible(e, _visible(e))


def topk_old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return _topk_visible(e, _visible(e, 2))


def _log(e: DataFrame) -> DataFrame:
    op = F.when(F.col("vec_id") % 4 == 3, "delete").otherwise("insert")
    return e.select(F.col("vec_id").alias("log_offset"), op.alias("op"), (F.col("vec_id") % 100 + 1).alias("node_id"), F.col("vec_id").alias("external_id"))


def mutation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_mutations(_log(_embeddings(spark, sf_dir))).select("node_id", "op", "log_offset")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(_embeddings(spark, sf_dir)).where("log_offset >= 250").select("log_offset", "op", "node_id")


def start_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    n = e.select((F.col("vec_id") + 1).alias("node_id"), "label")
    default = n.agg(F.min("node_id").alias("node_id")).select(F.lit(-1).cast("bigint").alias("label"), "node_id")
    return default.unionByName(n.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.min("node_id").alias("node_id")))


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    ids = _nodes(e).select("node_id").unionByName(_tombstones(e).select("node_id"))
    return ids.agg(F.max("node_id").alias("high_water")).join(_tombstones(e).agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("max_epoch")))


def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir).select("vec_id")
    both = e.unionByName(e.select((F.col("vec_id") + 400).alias("vec_id")))
    return both.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are valid after every 11th was cut short and every 13th made infinite."""
    spoilt = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x: F.lit(float("inf")))).otherwise(F.col("embedding").cast("array<double>"))
    rows = _embeddings(spark, sf_dir).select(spoilt.alias("v"))
    ok, size = is_valid_vector(F.col("v"), 64), F.size("v") == 64
    return rows.agg(F.sum(ok.cast("bigint")).alias("valid"), F.sum((~size).cast("bigint")).alias("bad_size"), F.sum((size & ~ok).cast("bigint")).alias("not_finite"))


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    mine = label_set(F.array(F.col("label"), (F.col("label") + F.col("vec_id")) % 10, F.col("label")))
    other = label_set(F.array(F.col("vec_id") % 10, F.lit(3)))
    base = label_set(F.array(F.lit(3), F.lit(4)))
    return e.select("vec_id", mine.alias("a"), other.alias("b"), base.alias("c")).select(
        "vec_id", F.array_join(F.col("a").cast("array<string>"), ",").alias("labels"), F.arrays_overlap("a", "b").alias("overlap"), contains_intersection(F.col("c"), F.col("a"), F.col("b")).alias("contained")
    )


# -- graphs ------------------------------------------------------------------


#: Rows that a shard of the queries' indexes has at most, so that their work is dealt over more tasks with more rows.
SHARD_ROWS = 125


def _shards(n: int) -> int:
    return n // SHARD_ROWS + 1


def _built(spark: SparkSession, sf_dir: str, **config) -> tuple[VectorIndex, DataFrame, int]:
    """An index over all rows, in memory, the queries, and the number of rows."""
    e = _embeddings(spark, sf_dir)
    n = e.count()
    labels = {"labels": F.array(F.col("label").cast("smallint"))} if config.get("has_labels") else {}
    rows = e.select(F.col("vec_id").alias("external_id"), F.col("embedding").alias("vector"), *[c.alias(name) for name, c in labels.items()])
    index = VectorIndex.create(spark, "memory:", IndexConfig(64, **BUILD | {"shards": _shards(n)} | config))
    index.bulk_build(rows)
    return index, _asked(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), n


def _budget(n: int) -> QueryBudget:
    return QueryBudget(max_visited=n, max_candidates=2 * n, max_rescore=n, max_query_bytes=1 << 30)


def graph_full_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q, n = _built(spark, sf_dir)
    return _shown(index.search(q, K, n, budget=_budget(n)), "external_id")


def graph_walk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q, n = _built(spark, sf_dir, has_labels=True)
    return _shown(index.search(q, K, n, filter=[1, 3], budget=_budget(n)), "external_id")


def graph_cosine_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q, n = _built(spark, sf_dir, distance="cosine")
    return _shown(index.search(q, K, n, budget=_budget(n)), "external_id")


def graph_inner_product_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q, n = _built(spark, sf_dir, distance="inner_product")
    return _shown(index.search(q, K, n, budget=_budget(n)), "external_id")


def graph_sbq_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q, n = _built(spark, sf_dir, quantizer=Quantizer(1))
    return _shown(index.search(q, K, n, budget=_budget(n)), "external_id")


def graph_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[0].invariants().where("rule <> 'invalid'")


def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, _ = _built(spark, sf_dir)
    return index.reachable().agg(F.count(F.lit(1)).alias("reachable"))


def graph_reachable_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first node of each shard."""
    index, _, _ = _built(spark, sf_dir)
    _checkpointed(spark)
    nodes = index.nodes()
    return reachable_by_joins(nodes, nodes.groupBy("shard").agg(F.min("node_id").alias("node_id"))).agg(F.count(F.lit(1)).alias("reachable"))


def graph_walk_small_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q, _ = _built(spark, sf_dir)
    return _shown(index.search(q, K, 64), "external_id")


def graph_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight graphs side by side; a walk as long as a shard finds all of it."""
    index, q, n = _built(spark, sf_dir, shards=8)
    return _shown(index.search(q, K, n, budget=_budget(n)), "external_id")


def graph_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built without every 50th row, which is then inserted; rows 1 to 5 are deleted."""
    e = _embeddings(spark, sf_dir)
    rows = e.select(F.col("vec_id").alias("external_id"), F.col("embedding").alias("vector"))
    n = e.count()
    index = VectorIndex.create(spark, "memory:", IndexConfig(64, **BUILD, shards=_shards(n)))
    index.bulk_build(rows.where("external_id % 50 <> 7"))
    index.insert(rows.where("external_id % 50 = 7"))
    index.delete(rows.where("external_id between 1 and 5").select("external_id"))
    q = _asked(e).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _shown(index.search(q, K, n, budget=_budget(n)), "external_id")


def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each case whose budget or arguments do not allow the search."""
    index, q, _ = _built(spark, sf_dir)
    cases = {
        "max_visited": lambda: index.search(q, 5, 50, budget=QueryBudget(max_visited=10)),
        "max_candidates": lambda: index.search(q, 5, 50, budget=QueryBudget(max_candidates=20)),
        "max_rescore": lambda: index.search(q, 5, 50, budget=QueryBudget(max_rescore=10)),
        "max_full_vector_bytes": lambda: index.search(q, 5, 50, budget=QueryBudget(max_full_vector_bytes=7)),
        "max_query_bytes": lambda: index.search(q, 5, 50, budget=QueryBudget(max_query_bytes=1)),
        "list_under_limit": lambda: index.search(q, 5, 4),
        "no_limit": lambda: SearchOptions(0, 1),
        "wrong_size": lambda: index.search(q.withColumn("vector", F.slice("vector", 1, 3)), 5, 50),
        "enough": lambda: index.search(q, 5, 50),
    }
    from .index import run_typed

    out = []
    for name, case in cases.items():
        try:
            made = case()
            if isinstance(made, DataFrame):
                run_typed(made)
            out.append((name, "OK"))
        except VectorIndexError as e:
            out.append((name, e.code))
    return spark.createDataFrame(out, "case string, code string")


def _ingested(spark: SparkSession, log: DataFrame) -> DataFrame:
    """What is visible after a stream has taken in a log."""
    from .streaming import ingest, mutation_stream

    import uuid

    _checkpointed(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    index = VectorIndex.create(spark, "memory:", IndexConfig(64, max_neighbors=8, build_search_list_size=16, shards=_shards(log.count())))
    log.write.parquet(f"{folder}/log")
    ingest(index, mutation_stream(spark, f"{folder}/log", 1 << 20), f"{folder}/checkpoint").awaitTermination()
    return index.nodes().select("node_id", "external_id")


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that inserts the whole table and then deletes every row whose id is divisible by 20."""
    e = _embeddings(spark, sf_dir)
    rows = lambda e, op, after: e.select(
        (F.col("vec_id") + after).alias("log_offset"), F.lit(op).alias("op"), (F.col("vec_id") + 1).alias("node_id"), F.col("vec_id").alias("external_id"), F.col("embedding").alias("full_vector"), F.array().cast("array<smallint>").alias("labels")
    )
    return _ingested(spark, rows(e, "insert", 0).unionByName(rows(e.where(EVERY_20TH), "delete", e.agg(F.max("vec_id")).first()[0] + 1)))


def _checkpointed(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vecstrata-"))


def graph_reachable_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over derived lists, some of whose ids have no row, that both limits cut short."""
    _checkpointed(spark)
    e = _embeddings(spark, sf_dir).select((F.col("vec_id") + 1).alias("node_id"))
    n = e.count()
    i = F.col("node_id")
    nodes = e.withColumn("neighbors", F.array(2 * i, i * 7 % n + 1, 2 * i + 1, i))
    starts = spark.createDataFrame([(3,), (1,)], "node_id bigint")
    return reachable_bounded(nodes, starts, n * 7 // 10, n * 8 // 10)


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows by segment, and a registry where each segment was trained on half of its rows first and on all of them then."""
    rows = _embeddings(spark, sf_dir).select("vec_id", (F.col("vec_id") % 4).cast("string").alias("scope"), F.col("embedding").alias("vector"))
    registry = spark.createDataFrame([], REGISTRY)
    for ref, part in enumerate((rows.where("vec_id % 8 < 4"), rows), 1):
        registry = registered(registry, train_scopes(part), Quantizer(2), ref)
    return rows, registry


def quantizer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest statistics of each segment."""
    _, registry = _scoped(spark, sf_dir)
    flat = latest(registry).select("scope", "version", "count", F.posexplode(F.arrays_zip("mean", "m2")).alias("dim", "s"))
    return flat.select("scope", "version", "count", F.col("dim").cast("bigint").alias("dim"), F.round("s.mean", 6).alias("mean"), F.round("s.m2", 6).alias("m2"))


def sbq_encode_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-bit codes under each row's own segment's latest thresholds."""
    coded = ones_by_scope(*_scoped(spark, sf_dir))
    return coded.select("vec_id", "scope", F.posexplode("ones").alias("dim", "x")).select("vec_id", "scope", F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("bigint").alias("ones"))


def graph_change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is visible over a base and three change sets, before and after they are made one."""
    _checkpointed(spark)
    rows = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("external_id"), F.col("embedding").alias("vector"))
    index = VectorIndex.create(spark, "memory:", IndexConfig(64, max_neighbors=12, build_search_list_size=16, shards=_shards(rows.count())))
    index.bulk_build(rows.where("external_id % 25 > 1"))
    index.insert(rows.where("external_id % 25 = 0"))
    index.delete(rows.where("external_id % 25 in (0, 5) and external_id % 2 = 0").select("external_id"))
    index.insert(rows.where("external_id % 25 = 1"))
    shown = lambda stage: index.nodes().select(F.lit(stage).alias("stage"), "external_id", F.round(F.col("full_vector")[0].cast("double"), 6).alias("v0"))
    before = shown("before").checkpoint()
    index.compact()
    return before.unionByName(shown("after"))


# -- SQL -----------------------------------------------------------------------

L2 = "list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda z: z[1] * z[2]))"
SIGN = "case when x > m then 1 else 0 end"


def _topk_sql(distance: str, where: str = "true", a: str = "q.embedding", b: str = "e.embedding", of: str = "embeddings", id_: str = "vec_id", k: int = K, name: str = "vec_id") -> str:
    value = distance.format(a=a, b=b)
    return f"""
select query_id, rank, id as {name}, round(distance, 6) as distance from (
  select *, row_number() over (partition by query_id order by distance, id) as rank from (
    select q.vec_id as query_id, e.{id_} as id, {value} as distance from embeddings q, {of} e where q.{EVERY_20TH} and {where})) where rank <= {k}"""


def _two_phase_sql(cheap: str, of: str, size: int) -> str:
    exact = L2.format(a="q.embedding", b="e.embedding")
    return f"""
select query_id, rank, vec_id, round(distance, 6) as distance from (
  select query_id, vec_id, distance, row_number() over (partition by query_id order by distance, vec_id) as rank from (
    select c.query_id, c.vec_id, {exact} as distance from (
      select *, row_number() over (partition by query_id order by d, vec_id) as r from (
        select q.vec_id as query_id, e.vec_id, {cheap} as d from {of} q, {of} e where q.{EVERY_20TH})) c
    join embeddings q on q.vec_id = c.query_id join embeddings e on e.vec_id = c.vec_id where c.r <= {size})) where rank <= {K}"""


CODES = f"""
with flat as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
stats as (select dim, count(*) as n, avg(x) as m, var_pop(x) as v from flat group by dim),
codes as (select vec_id, list({SIGN} order by dim) as code from flat join stats using (dim) group by vec_id)
"""
BITS_APART = "list_sum(list_transform(list_zip(q.code, e.code), lambda z: case when z[1] <> z[2] then 1 else 0 end))::double"
VISIBLE = """
with n as (select count(*) as n from embeddings),
tomb as (select vec_id + 1 as node_id, vec_id // 10 + 1 as epoch from embeddings where vec_id % 10 = 0),
vis as (
  select e.vec_id + 1 as node_id,
         case when e.vec_id % 7 = 0 then e.vec_id + 100000 else e.vec_id end as external_id,
         case when e.vec_id % 7 = 0 then list_transform(embedding::double[], lambda x: -x) else embedding::double[] end as v,
         case when e.vec_id % 7 <> 0 and e.vec_id % 5 = 0 then concat((e.vec_id + 1) % n + 1, ',', (e.vec_id + 2) % n + 1) else '' end as neighbors
  from embeddings e, n where not exists (select 1 from tomb t where t.node_id = e.vec_id + 1 and t.epoch <= {epoch}))
"""


def _visible_topk_sql(epoch: int) -> str:
    return VISIBLE.format(epoch=epoch) + _topk_sql(L2, b="e.v", of="vis", id_="node_id", name="node_id")


def _recall_sql() -> str:
    exact = L2.format(a="q.embedding", b="e.embedding")
    return (
        CODES.rstrip()
        + f""", cheap as (
  select *, row_number() over (partition by query_id order by d, vec_id) as r from (
    select q.vec_id as query_id, e.vec_id, {BITS_APART} as d from codes q, codes e where q.{EVERY_20TH})),
dist as (select q.vec_id as query_id, e.vec_id, {exact} as distance from embeddings q, embeddings e where q.{EVERY_20TH}),
truth as (select query_id, vec_id from (select *, row_number() over (partition by query_id order by distance, vec_id) as r from dist) where r <= {K}),
sizes as (select unnest([50, 100, 200, 400])::bigint as list_size),
hits as (
  select list_size, query_id, vec_id from (
    select s.list_size, c.query_id, c.vec_id, row_number() over (partition by s.list_size, c.query_id order by d.distance, c.vec_id) as r
    from sizes s join cheap c on c.r <= s.list_size join dist d on d.query_id = c.query_id and d.vec_id = c.vec_id) where r <= {K})
select s.list_size, round(count(t.vec_id) / ({float(K)} * (select count(*) from embeddings where {EVERY_20TH})), 6) as recall
from sizes s left join hits h using (list_size) left join truth t on t.query_id = h.query_id and t.vec_id = h.vec_id group by s.list_size"""
    )


SCOPED = f"""
with flat as (select vec_id, (vec_id % 4)::varchar as scope, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
stats as (select scope, dim, count(*) as n, avg(x) as m, var_pop(x) as v from flat group by all)
"""


def _reachable_sql(levels: int = 24) -> str:
    """Levels one after the other: the rank of a new node is how many were queued before it."""
    most, room = "(select count(*) * 7 // 10 from embeddings)", "(select count(*) * 8 // 10 from embeddings)"
    parts = [
        "e as (select vec_id + 1 as i, count(*) over () as n from embeddings)",
        "links as (select i as node_id, unnest([2 * i, i * 7 % n + 1, 2 * i + 1, i]) as t, unnest([0, 1, 2, 3]) as place from e)",
        "q0 as (select * from (values (1::bigint, 0::bigint, 0::bigint, false), (3, 1, 0, false)) t(node_id, rank, level, over))",
        "s0 as (select * from q0)",
    ]
    for k in range(1, levels + 1):
        parts.append(
            f"""q{k} as (
  select node_id, (select count(*) from s{k - 1} where not over) + row_number() over (order by of, place) - 1 as rank, {k}::bigint as level from (
    select t as node_id, min(q.rank * 4 + l.place) // 4 as of, min(q.rank * 4 + l.place) % 4 as place
    from q{k - 1} q join links l on l.node_id = q.node_id where not q.over and q.rank < {most} and t not in (select node_id from s{k - 1} where not over) group by t))"""
        )
        parts[-1] = f"r{k} as (select * from ({parts[-1].split(' as (', 1)[1][:-1]})), q{k} as (select *, rank >= {room} as over from r{k})"
        parts.append(f"s{k} as (select * from s{k - 1} union all select * from q{k})")
    last = f"s{levels}"
    return f"""with {", ".join(p.replace(" as (", " as materialized (", 1) for p in parts)}
select node_id, rank, level, node_id in (select i from e) as present,
       (select bool_or(over or rank >= {most}) from {last}) as truncated from {last} where not over and rank < {most}"""


NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def _divisor(v: str) -> str:
    """What a vector is divided by for cosine: 1 if it is of unit length up to rounding, or zero."""
    n = NORM.format(v=v)
    return f"case when abs({n} * {n} - 1) <= 64 * 1.1920928955078125e-07 or {n} * {n} < 1.1920928955078125e-07 then 1.0 else {n} end"


SCALED = "list_transform(embedding::double[], lambda x: x * (1 + vec_id % 5))"

SQL = {
    "topk_l2": _topk_sql(L2),
    "topk_cosine": _topk_sql(f"greatest(0, 1 - {DOT} / ({_divisor('q.embedding::double[]')} * {_divisor('e.embedding::double[]')}))"),
    "topk_inner_product": _topk_sql("-" + DOT),
    "topk_l2_filtered": _topk_sql(L2, "e.label in (1, 3)"),
    "topk_empty_filter": _topk_sql(L2),
    "topk_prefix_norescore": _topk_sql(L2, a="q.embedding[1:16]", b="e.embedding[1:16]"),
    "topk_prefix_rescored": _two_phase_sql(L2.format(a="q.embedding[1:16]", b="e.embedding[1:16]"), "embeddings", 64),
    "cosine_normalised": f"""
select vec_id, round(case when abs(n * n - 1) <= 64 * 1.1920928955078125e-07 then 1.0 else n end, 6) as norm,
       round(n / case when abs(n * n - 1) <= 64 * 1.1920928955078125e-07 then 1.0 else n end, 6) as after
from (select vec_id, {NORM.format(v=SCALED)} as n from embeddings)""",
    "sbq_train": CODES + "select dim, n as count, round(m, 6) as mean, round(v * n, 6) as m2 from stats",
    "sbq_encode_1bit": CODES + f"select vec_id, dim, ({SIGN})::bigint as bit from flat join stats using (dim)",
    "sbq_encode_2bit": CODES + "select vec_id, dim, greatest(0, least(2, floor(((x - m) / sqrt(v) + 2) / (4.0 / 3))))::bigint as ones from flat join stats using (dim)",
    "sbq_encode_nomean": CODES + "select vec_id, dim, (case when x > 0 then 1 else 0 end)::bigint as bit from flat",
    "hamming_topk": CODES + _topk_sql(BITS_APART, of="codes").replace("from embeddings q", "from codes q"),
    "sbq_two_phase": CODES + _two_phase_sql(BITS_APART, "codes", 100),
    "sbq_recall": _recall_sql(),
    "visible_nodes": VISIBLE.format(epoch=EPOCH) + "select node_id, external_id, neighbors, round(v[1], 6) as v0 from vis",
    "node_reads": VISIBLE.format(epoch=EPOCH)
    + f""", asked as (select i as pos, i + 1 as node_id from range((select count(*) + 40 from embeddings)) t(i))
select a.pos, a.node_id, v.external_id,
       case when t.node_id is not null then 'Tombstoned' when v.node_id is not null then 'Present' else 'Missing' end as status
from asked a left join vis v using (node_id) left join (select node_id from tomb where epoch <= {EPOCH}) t using (node_id)""",
    "topk_after_mutations": _visible_topk_sql(EPOCH),
    "topk_old_snapshot": _visible_topk_sql(2),
    "mutation_fold": """
select node_id, op, log_offset from (
  select vec_id % 100 + 1 as node_id, case when vec_id % 4 = 3 then 'delete' else 'insert' end as op, vec_id as log_offset,
         row_number() over (partition by vec_id % 100 order by vec_id desc) as r from embeddings) where r = 1""",
    "log_tail": "select vec_id as log_offset, case when vec_id % 4 = 3 then 'delete' else 'insert' end as op, vec_id % 100 + 1 as node_id from embeddings where vec_id >= 250",
    "start_nodes": "select -1::bigint as label, min(vec_id) + 1 as node_id from embeddings union all select label::bigint, min(vec_id) + 1 from embeddings group by label",
    "high_water": "select max(vec_id) + 1 as high_water, max(case when vec_id % 10 = 0 then vec_id // 10 + 1 else 0 end) as max_epoch from embeddings",
    "id_uniqueness": "select vec_id, count(*) as n from (select vec_id from embeddings union all select vec_id + 400 from embeddings) group by vec_id having count(*) > 1",
    "validate_vectors": """
select sum(case when vec_id % 11 <> 0 and vec_id % 13 <> 0 then 1 else 0 end)::bigint as valid, sum(case when vec_id % 11 = 0 then 1 else 0 end)::bigint as bad_size,
       sum(case when vec_id % 11 <> 0 and vec_id % 13 = 0 then 1 else 0 end)::bigint as not_finite from embeddings""",
    "label_sets": """
with s as (select vec_id, list_sort(list_distinct([label, (label + vec_id) % 10])) as a, list_distinct([vec_id % 10, 3]) as b from embeddings)
select vec_id, array_to_string(a, ',') as labels, list_has_any(a, b) as overlap, len(list_filter(list_intersect(a, b), lambda x: x not in (3, 4))) = 0 as contained from s""",
    "graph_full_walk": _topk_sql(L2),
    "graph_walk_filtered": _topk_sql(L2, "e.label in (1, 3)"),
    "graph_sbq_walk": _topk_sql(L2),
    "graph_inner_product_walk": _topk_sql("-" + DOT),
    "graph_sharded": _topk_sql(L2),
    "graph_invariants": "select unnest(['too_many_neighbors', 'self_edge', 'repeated_neighbor']) as rule, 0::bigint as violations",
    "graph_reachable": "select count(*) as reachable from embeddings",
    "graph_reachable_joins": "select count(*) as reachable from embeddings",
    "graph_insert_delete": _topk_sql(L2, "e.vec_id not between 1 and 5"),
    "budget_violations": """
select * from (values ('max_visited', 'BUDGET_EXCEEDED'), ('max_candidates', 'BUDGET_EXCEEDED'), ('max_rescore', 'BUDGET_EXCEEDED'),
  ('max_full_vector_bytes', 'BUDGET_EXCEEDED'), ('max_query_bytes', 'BUDGET_EXCEEDED'), ('list_under_limit', 'INVALID_ARGUMENT'), ('no_limit', 'INVALID_ARGUMENT'),
  ('wrong_size', 'DIMENSION_MISMATCH'), ('enough', 'OK')) t("case", code)""",
    "graph_reachable_bounded": _reachable_sql(),
    "quantizer_registry": SCOPED + "select scope, 2::bigint as version, n as count, dim, round(m, 6) as mean, round(v * n, 6) as m2 from stats",
    "sbq_encode_by_segment": SCOPED + "select vec_id, scope, dim, greatest(0, least(2, floor(((x - m) / sqrt(v) + 2) / (4.0 / 3))))::bigint as ones from flat join stats using (scope, dim)",
    "graph_change_sets": """
select stage, vec_id as external_id, round(embedding[1]::double, 6) as v0 from embeddings, (values ('before'), ('after')) t(stage)
where not (vec_id % 25 in (0, 5) and vec_id % 2 = 0)""",
    "streaming_ingest": "select vec_id + 1 as node_id, vec_id as external_id from embeddings where vec_id % 20 <> 0",
}
SQL["graph_cosine_walk"] = SQL["topk_cosine"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "topk_l2": _exact("l2"),
        "topk_cosine": _exact("cosine"),
        "topk_inner_product": _exact("inner_product"),
        "topk_l2_filtered": _filtered((1, 3)),
        "topk_empty_filter": _filtered(()),
        "topk_prefix_norescore": topk_prefix_norescore,
        "topk_prefix_rescored": topk_prefix_rescored,
        "cosine_normalised": cosine_normalised,
        "sbq_train": sbq_train,
        "sbq_encode_1bit": lambda s, d: _bits(_embeddings(s, d), 1, True, "bit"),
        "sbq_encode_2bit": lambda s, d: _bits(_embeddings(s, d), 2, True, "ones"),
        "sbq_encode_nomean": lambda s, d: _bits(_embeddings(s, d), 1, False, "bit"),
        "hamming_topk": hamming_topk,
        "sbq_two_phase": sbq_two_phase,
        "sbq_recall": sbq_recall,
        "visible_nodes": visible,
        "node_reads": reads,
        "topk_after_mutations": topk_after_mutations,
        "topk_old_snapshot": topk_old_snapshot,
        "mutation_fold": mutation_fold,
        "log_tail": log_tail,
        "start_nodes": start_nodes,
        "high_water": high_water,
        "id_uniqueness": id_uniqueness,
        "validate_vectors": validate_vectors,
        "label_sets": label_sets,
        "graph_full_walk": graph_full_walk,
        "graph_walk_filtered": graph_walk_filtered,
        "graph_cosine_walk": graph_cosine_walk,
        "graph_inner_product_walk": graph_inner_product_walk,
        "graph_sbq_walk": graph_sbq_walk,
        "graph_invariants": graph_invariants,
        "graph_reachable": graph_reachable,
        "graph_reachable_joins": graph_reachable_joins,
        "graph_walk_small_l": graph_walk_small_l,
        "graph_sharded": graph_sharded,
        "graph_insert_delete": graph_insert_delete,
        "graph_change_sets": graph_change_sets,
        "graph_reachable_bounded": graph_reachable_bounded,
        "quantizer_registry": quantizer_registry,
        "sbq_encode_by_segment": sbq_encode_by_segment,
        "budget_violations": budget_violations,
        "streaming_ingest": streaming_ingest,
    }
    return found
