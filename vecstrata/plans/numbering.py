"""Consecutive numbers over a whole table, and numbers of its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows cut into sorted ranges, numbered by ``_range``, and written once where there is a checkpoint folder."""
    held = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return held.persist() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else held.checkpoint()


def _of_range(starts: dict[int, int], otherwise: int) -> Column:
    """The number that each range starts at; one entry a partition."""
    pairs = [F.lit(x) for kv in starts.items() for x in kv]
    return F.coalesce(F.create_map(*pairs).cast("map<int,bigint>")[F.col("_range")], F.lit(otherwise)) if pairs else F.lit(otherwise)


def numbered(df: DataFrame, order: list[str], first: int, name: str = "node_id") -> DataFrame:
    """Consecutive numbers from ``first`` in the given order, without a task that sees all rows.

    Rows are cut into sorted ranges and written once; the ranges' sizes, a
    number for each partition, give where each range starts.
    """
    held = _ranges(df, order)
    sizes = dict(held.groupBy("_range").count().collect())
    starts, at = {}, first
    for k in sorted(sizes):
        starts[k] = at
        at += sizes[k]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.withColumn(name, (_of_range(starts, first) + place - 1).cast("bigint")).drop("_range")


def runs(df: DataFrame, order: list[str], value: str, name: str = "run") -> DataFrame:
    """The number, from 0, of the run of equal ``value`` (null equals null) that each row is in, in the given order.

    As in ``numbered`` no task sees all rows and nothing a run reaches the driver:
    changes are counted within sorted ranges, and each range's first and last value
    and its count, a row a partition, tell the number that the next one starts at.
    """
    held, by = _ranges(df, order), Window.partitionBy("_range").orderBy(*order)
    turn = F.when(F.row_number().over(by) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("bigint"))
    counted = held.withColumn("_turn", turn).withColumn("_turn", F.sum("_turn").over(by))
    place = F.struct(*order)
    ends = counted.groupBy("_range").agg(F.min_by(value, place).alias("head"), F.max_by(value, place).alias("tail"), F.max("_turn").alias("turns")).collect()
    starts, at, before = {}, 0, None
    for r in sorted(ends, key=lambda r: r["_range"]):
        at += before is not None and before.tail != r.head
        starts[r["_range"]], before = at, r
        at += r.turns
    return counted.withColumn(name, (_of_range(starts, 0) + F.col("_turn")).cast("bigint")).drop("_range", "_turn")
