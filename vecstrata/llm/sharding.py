"""Sharding by proportional stratified interleaving.

Within each source the rows are put in a seeded random order, and the row at
rank r of n gets the fractional rank (2r + 1) / 2n.  Sorted by fractional rank
the sources interleave in proportion, so any run of the sorted rows has the
mixture of the whole.  Cutting the order into equal runs gives shards whose row
counts differ by one at most (law ``rows``).

No rank needs one task for a source or for the table: keys are cut into ranges
of equal width, rows are ranked inside a range, and running totals over the
at most 65,536 ranges give the rest.  Texts never shuffle, only their sizes and
checksums do.

Defined cases: a null text has no bytes (size 1, checksum 0); rows with a null
source form a stratum of their own; a null id is ranked by its text's checksum
and size; repeated rows get places of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import power_of_two, settle

#: Width of the seeded key: the first 13 hexadecimal digits of an MD5 sum.
KEY_BITS = 52


def interleaved_shards(
    docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, frac."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, KEY_BITS // 4)
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("bytes"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.col(source_col).cast("string").alias("source"),
            F.conv(digits, 16, 10).cast("bigint").alias("key"),
        ).withColumn("stratum", F.concat_ws("", F.when(F.col("source").isNull(), "n").otherwise("s"), "source"))
    )
    total = rows.count()
    ranges = power_of_two(total / 256, 1, 65536)

    rows = rows.withColumn("range", F.expr(f"key div {2**KEY_BITS // ranges}"))
    counts = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        counts.select(
            "stratum", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("stratum")).alias("of")
        )
    )
    inside = Window.partitionBy("stratum", "range").orderBy("key", "doc_id", "crc", "bytes")
    ranked = settle(
        rows.join(starts.withColumnsRenamed({"stratum": "st", "range": "rg"}), (F.col("stratum") == F.col("st")) & (F.col("range") == F.col("rg")))
        .withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
        .select("doc_id", "bytes", "crc", "source", "stratum", ((2 * F.col("rank") + 1) / (2 * F.col("of"))).alias("frac"))
        .withColumn("range", F.least(F.floor(F.col("frac") * ranges), F.lit(ranges - 1)))
    )

    ends = ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ends = settle(ends.select(F.col("range").alias("rg"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    place = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("frac", "stratum", "doc_id", "crc", "bytes")) - 1
    placed = ranked.join(ends, F.col("range") == F.col("rg")).withColumn("place", place)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        (F.col("bytes") + 1).alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "frac",
    )
