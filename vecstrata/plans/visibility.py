"""What a snapshot shows of versioned tables, as one plan without loops.

Precedence: a tombstone up to the snapshot's epoch hides a node; then a hot
record replaces all else; then a neighbour rewrite changes the immutable row;
then the first segment that has the node, in manifest order; else it is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Changed nodes whose ids and neighbour lists are broadcast, at most; the node rows then stay where they are.
FEW_CHANGES = 1 << 17


def first_segment(segments: DataFrame) -> DataFrame:
    """One row a node from rows with a ``seg_pos``, the position of their segment in the manifest."""
    by = [c for c in ("shard", "node_id") if c in segments.columns]  # rows that are laid out by shard need no shuffle
    place = F.row_number().over(Window.partitionBy(*by).orderBy("seg_pos"))
    return segments.withColumn("_place", place).where("_place = 1").drop("_place", "seg_pos")


def visible_nodes(base: DataFrame, records: DataFrame | None = None, rewrites: DataFrame | None = None, tombstones: DataFrame | None = None, epoch: int = 0, few: bool = False) -> DataFrame:
    """The visible node rows; all inputs have ``node_id``, and ``base`` and ``records`` the same columns.

    ``few``: the caller knows that there are at most ``FEW_CHANGES`` changes, so that
    they are broadcast and rows laid out by shard are not shuffled.
    """
    side: Callable[[DataFrame], DataFrame] = F.broadcast if few else lambda df: df
    out = base
    if records is not None:
        hot = records.select("node_id")
        out = out.join(side(hot), "node_id", "left_anti").select(*base.columns).unionByName(records)
        rewrites = None if rewrites is None else rewrites.join(side(hot), "node_id", "left_anti")
    if rewrites is not None:  # after the union: a computed column below it hides how the rows are laid out
        changed = rewrites.select("node_id", F.col("neighbors").alias("_new"))
        out = out.join(side(changed), "node_id", "left").withColumn("neighbors", F.coalesce("_new", "neighbors")).select(*base.columns)
    if tombstones is not None:
        out = out.join(side(tombstones.where(F.col("epoch") <= epoch).select("node_id")), "node_id", "left_anti").select(*base.columns)
    return out


def merged_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rewrites, tombstones) of a chain of change sets.

    ``changes`` are node rows with ``kind`` (record, rewrite or tombstone), ``epoch``
    and ``set_pos``, which grows along the chain.  A record is the whole row of
    a node, a rewrite only its neighbours; of a node the neighbours of the latest set
    count.  A set has one record or rewrite of a node at most.
    """
    by = [c for c in ("shard", "node_id") if c in changes.columns]
    latest = Window.partitionBy(*by).orderBy(F.desc("set_pos"))
    rows = changes.where("kind <> 'tombstone'").withColumns(
        {
            "neighbors": F.first("neighbors").over(latest),
            "_place": F.row_number().over(latest),
            "_first": F.min("kind").over(Window.partitionBy(*by)),  # "record" is the smaller; a computed column would move below the union of the sets and hide their layout
        }
    )
    plain = [c for c in changes.columns if c not in ("kind", "epoch", "set_pos")]
    records = rows.where("kind = 'record'").select(*plain)
    rewrites = rows.where("_first = 'rewrite' and _place = 1").select("node_id", "neighbors")
    return records, rewrites, changes.where("kind = 'tombstone'").select("node_id", "epoch")


def node_reads(requested: DataFrame, visible: DataFrame, tombstones: DataFrame | None, epoch: int) -> DataFrame:
    """Each requested (pos, node_id) with its status, and the node's columns where Present."""
    rows = requested.join(visible.withColumn("_here", F.lit(True)), "node_id", "left")
    if tombstones is None:
        dead = F.lit(False)
    else:
        rows = rows.join(tombstones.where(F.col("epoch") <= epoch).select("node_id", F.lit(True).alias("_dead")).distinct(), "node_id", "left")
        dead = F.col("_dead").isNotNull()
    status = F.when(dead, "Tombstoned").when(F.col("_here").isNotNull(), "Present").otherwise("Missing")
    return rows.withColumn("status", status).drop("_here", "_dead")


def fold_mutations(log: DataFrame) -> DataFrame:
    """The last operation of each node of an ordered log."""
    last = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("log_offset")))
    return log.withColumn("_last", last).where("_last = 1").drop("_last")
