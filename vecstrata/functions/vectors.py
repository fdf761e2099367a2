"""Distances, label sets and validation as columns, in double precision.

All of them are built-in expressions, so they stay on the JVM and may be used in
any projection, filter or join condition.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Single-precision machine epsilon, the tolerance of the norm tests.
EPSILON = 2.0**-23


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def neg_inner_product(a: Column, b: Column) -> Column:
    """Smaller is better, and it may be negative."""
    return -dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of vectors already of unit length (or zero); see ``normalised``."""
    return F.greatest(F.lit(0.0), 1.0 - dot(a, b))


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"l2": l2_squared, "cosine": cosine_distance, "inner_product": neg_inner_product}[metric](a, b)


def cosine_norm(v: Column) -> Column:
    """The norm to divide by; null for zero vectors and vectors of unit length up to rounding."""
    squares = dot(v, v)
    near_one = F.abs(squares - 1.0) <= EPSILON * F.size(v)
    return F.when((squares < EPSILON) | near_one, F.lit(None).cast("double")).otherwise(F.sqrt(squares))


def normalised(v: Column) -> Column:
    """The vector in doubles, divided by ``cosine_norm`` where there is one."""
    norm = cosine_norm(v)
    return F.when(norm.isNull(), v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def prefix(v: Column, dimensions: int) -> Column:
    return F.slice(v, 1, dimensions)


def label_set(labels: Column) -> Column:
    """Sorted distinct labels; null is the empty set."""
    return F.array_sort(F.array_distinct(F.coalesce(labels.cast("array<smallint>"), F.array().cast("array<smallint>"))))


def labels_match(labels: Column, wanted: Column) -> Column:
    """Whether the sets overlap; a null or empty filter matches all rows."""
    return F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.coalesce(F.arrays_overlap(labels, wanted), F.lit(False))


def contains_intersection(base: Column, a: Column, b: Column) -> Column:
    """Whether ``base`` holds all that ``a`` and ``b`` have in common."""
    return F.size(F.array_except(F.array_intersect(a, b), base)) == 0


def is_valid_vector(v: Column, dimensions: int) -> Column:
    """Whether it has the right size and only finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))


def valid_node(node_id: Column, neighbors: Column, most: int) -> Column:
    """Whether a neighbour list is short enough, without the node itself and without repeats."""
    return (F.size(neighbors) <= most) & ~F.array_contains(neighbors, node_id) & (F.size(F.array_distinct(neighbors)) == F.size(neighbors))


def register(spark: SparkSession) -> None:
    """Temporary SQL functions with lambda bodies, inlined by the optimizer."""
    vector = "array<double>"
    total = "aggregate(zip_with(a, b, (x, y) -> {0}), 0D, (s, x) -> s + x)"
    for name, kinds, result, body in (
        ("l2_squared", (vector, vector), "double", total.format("(x - y) * (x - y)")),
        ("inner_product", (vector, vector), "double", total.format("x * y")),
        ("neg_inner_product", (vector, vector), "double", "-" + total.format("x * y")),
        ("cosine_distance", (vector, vector), "double", "greatest(0D, 1D - " + total.format("x * y") + ")"),
        ("hamming", ("array<bigint>", "array<bigint>"), "bigint", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)"),
        ("labels_match", ("array<smallint>", "array<smallint>"), "boolean", "coalesce(size(b) <= 0, true) or coalesce(arrays_overlap(a, b), false)"),
    ):
        spark.sql(f"create or replace temporary function {name}(a {kinds[0]}, b {kinds[1]}) returns {result} return {body}")
