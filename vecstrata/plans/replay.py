"""The rules that a mutation log is held to, for all of its rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_valid_vector, label_set

_OPEN = (1 << 63) - 1


def _fault(code: str, says: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(says).alias("says"))


def first_fault(log: DataFrame, visible: DataFrame, dead: DataFrame | None, dimensions: int, has_labels: bool) -> Row | None:
    """(run, log_offset, code, says) of the first row of a log that breaks a rule, or None.

    ``log`` has log_offset, run, op, node_id, external_id, full_vector and labels;
    ``visible(node_id, external_id)`` is what the log starts from, ``dead(node_id)``
    the ids removed before.  Inserted vectors are of the right size and finite, labels
    only where the index has them, node ids are positive and never given out twice,
    an external id belongs to one visible row at a time, and a delete names a row
    that is there when its turn comes.  Windows are by id; the rows of a log meet
    those of the index by semi-joins on ids, vectors are looked at where they lie.
    """
    insert, n = F.col("op") == "insert", F.col("node_id")
    own = (
        F.when(n.isNull() | (n < 1), _fault("INVALID_ARGUMENT", "a node id is missing"))
        .when(~F.coalesce(F.col("op").isin("insert", "delete"), F.lit(False)), _fault("INVALID_ARGUMENT", "no such operation"))
        .when(insert & (F.coalesce(F.size("full_vector"), F.lit(-1)) != dimensions), _fault("DIMENSION_MISMATCH", f"a row is not of {dimensions} dimensions"))
        .when(insert & ~is_valid_vector(F.col("full_vector").cast("array<float>"), dimensions), _fault("INVALID_VECTOR", "a row is not finite"))
        .when(insert & F.lit(not has_labels) & (F.size(label_set(F.col("labels"))) > 0), _fault("INVALID_ARGUMENT", "a row has labels, the index has none"))
    )
    rows = log.select("run", "log_offset", "op", "node_id", "external_id", own.alias("fault"))
    ids = rows.select("node_id").distinct()
    here = visible.join(ids, "node_id", "left_semi").select("node_id", F.lit(True).alias("here"))
    gone = ids.where(F.lit(False)) if dead is None else dead.select("node_id").distinct().join(ids, "node_id", "left_semi")
    seen = rows.join(here, "node_id", "left").join(gone.select("node_id", F.lit(True).alias("gone")), "node_id", "left")
    turn = Window.partitionBy("node_id").orderBy("log_offset")
    seen = seen.withColumns({"place": F.row_number().over(turn), "last": F.lag("op").over(turn), "next": F.lead("op").over(turn), "after": F.lead("log_offset").over(turn)})
    here, gone = F.coalesce("here", F.lit(False)), F.coalesce("gone", F.lit(False))
    there = F.when(here, F.col("place") == 1).otherwise(~gone & (F.col("place") == 2) & (F.col("last") == "insert"))
    by_node = F.when(F.col("fault").isNotNull(), F.col("fault")).when(insert & (here | gone | (F.col("place") > 1)), _fault("INVALID_ARGUMENT", "node_id: one exists already"))
    by_node = by_node.when(~insert & ~there, _fault("INVALID_ARGUMENT", "an id to delete is not there"))

    # the time that an external id is taken: rows of the index from before the log on, others from their insert to their delete
    ends = F.when(F.col("next") == "delete", F.col("after"))
    taken = seen.where(insert).select("external_id", "run", "log_offset", ends.alias("until"))
    removed = rows.where("op = 'delete'").groupBy("node_id").agg(F.min("log_offset").alias("until"))
    before = visible.join(taken.select("external_id").distinct(), "external_id", "left_semi").join(removed, "node_id", "left")
    taken = taken.unionByName(before.select("external_id", F.lit(-1).cast("bigint").alias("run"), F.lit(-1).cast("bigint").alias("log_offset"), "until"))
    earlier = Window.partitionBy("external_id").orderBy("log_offset").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("busy", F.max(F.coalesce("until", F.lit(_OPEN))).over(earlier)).where("busy > log_offset and run >= 0")

    faults = seen.select("run", "log_offset", by_node.alias("fault")).where("fault is not null")
    faults = faults.unionByName(taken.select("run", "log_offset", _fault("INVALID_ARGUMENT", "external_id: one exists already").alias("fault")))
    first = faults.agg(F.min(F.struct("log_offset", "run", "fault")).alias("x")).first()["x"]
    return None if first is None else Row(run=first.run, log_offset=first.log_offset, code=first.fault.code, says=first.fault.says)
