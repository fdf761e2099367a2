"""Quantizers by scope and version.

A scope is whatever is quantized together, an index or one of its segments.  Each
training of a scope is a new version; the latest one counts.  Statistics of all
scopes are trained in one pass, and rows are encoded by their own scope's, which are
a few numbers a dimension and come to the rows by a join.

Defined cases: a scope without rows has no quantizer; rows whose scope has none have a
null code; versions start at 1; an empty registry is an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import Quantizer
from ..errors import StorageError
from ..functions.quantize import EPSILON

REGISTRY = "ref bigint, scope string, version bigint, dimensions int, bits_per_dimension int, use_mean boolean, count bigint, mean array<double>, m2 array<double>"
#: Scopes whose statistics are broadcast, at most.
FEW_SCOPES = 1 << 12


def train_scopes(rows: DataFrame, scope_col: str = "scope", vector_col: str = "vector") -> DataFrame:
    """(scope, count, mean, m2) of each scope's vectors, partial sums first."""
    flat = rows.select(F.col(scope_col).cast("string").alias("scope"), F.posexplode(vector_col).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = flat.groupBy("scope", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    by = stats.groupBy("scope").agg(F.max("n").alias("count"), F.array_sort(F.collect_list(F.struct("dim", "mean", (F.col("var") * F.col("n")).alias("m2")))).alias("s"))
    return by.select("scope", "count", F.col("s.mean").alias("mean"), F.col("s.m2").alias("m2"))


def latest(registry: DataFrame) -> DataFrame:
    """The newest version of each scope."""
    columns = [c for c in registry.columns if c != "scope"]
    return registry.groupBy("scope").agg(F.max_by(F.struct(*columns), "version").alias("q")).select("scope", "q.*")


def next_version(registry: DataFrame, scope: str) -> int:
    return (registry.where(F.col("scope") == scope).agg(F.max("version")).first()[0] or 0) + 1


def registered(registry: DataFrame, trained: DataFrame, quantizer: Quantizer, first_ref: int) -> DataFrame:
    """``registry`` with a new version of each scope of ``trained(scope, count, mean, m2)``."""
    last = registry.groupBy("scope").agg(F.max("version").alias("last"))
    fresh = trained.join(last, "scope", "left").select(
        F.lit(first_ref).cast("bigint").alias("ref"), "scope", (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("version"), F.size("mean").alias("dimensions"),
        F.lit(quantizer.bits).alias("bits_per_dimension"), F.lit(quantizer.use_mean).alias("use_mean"), "count", "mean", "m2",
    )
    return registry.unionByName(fresh)


def checked_quantizer(stored: Row | None, dimensions: int, quantizer: Quantizer) -> None:
    """An error if stored statistics do not have the shape that an index was made for."""
    if stored is None:
        raise StorageError("the quantizer is empty")
    size = dimensions if quantizer.use_mean else 0
    wanted = (dimensions, quantizer.bits, quantizer.use_mean, size, size)
    if (stored["dimensions"], stored["bits_per_dimension"], stored["use_mean"], len(stored["mean"]), len(stored["m2"])) != wanted or (quantizer.use_mean and stored["count"] < 1):
        raise StorageError("the quantizer does not fit the index")


def ones_by_scope(rows: DataFrame, registry: DataFrame, scope_col: str = "scope", vector_col: str = "vector") -> DataFrame:
    """``rows`` with ``ones``: for each dimension the ones of the unary code under the latest quantizer of the row's scope."""
    now = latest(registry).select(F.col("scope").alias("_scope"), "bits_per_dimension", "use_mean", "count", "mean", "m2")
    side = F.broadcast(now) if registry.select("scope").distinct().limit(FEW_SCOPES + 1).count() <= FEW_SCOPES else now
    joined = rows.join(side, F.col(scope_col).cast("string") == F.col("_scope"), "left")
    bits, v = F.col("bits_per_dimension"), F.col(vector_col)

    def spread(x: Column, t: Column) -> Column:
        std = F.sqrt(F.greatest(t["m2"], F.lit(0.0)) / F.col("count"))
        z = F.when(std <= EPSILON, 0.0).otherwise((x.cast("double") - t["mean"]) / std)
        return F.greatest(F.lit(0), F.least(bits, F.floor((z + 2.0) / (4.0 / (bits + 1))).cast("int")))

    plain = F.transform(v, lambda x: (x > 0).cast("int"))
    one = F.zip_with(v, F.col("mean"), lambda x, m: (x.cast("double") > m).cast("int"))
    many = F.zip_with(v, F.arrays_zip("mean", "m2"), spread)
    return joined.withColumn("ones", F.when(~F.col("use_mean"), plain).when(bits == 1, one).when(bits > 1, many)).select(*rows.columns, "ones")
