"""Exact de-duplication by two-pass Bloom filtering, in DataFrame operations only.

Texts are equal when their forms with each run of white space replaced by one
space are the same.  The rows are digested once.  The first pass counts, for
every position of a Bloom filter, how many rows set it and keeps the positions
set at least twice, packed into 64-bit words.  The second pass tests each row
against these words: a row with a position that no other row sets is certainly
unique and passes straight through, without a shuffle.  Only possibly repeated
rows are grouped by their digest, so false positives cost a little traffic and
never change a result.

The filter has 16 positions a row within [2**16, ``max_filter_bits``]; it is the
only thing broadcast and holds at most ``max_filter_bits / 64`` words.

Defined cases: a null text counts as empty; null ids sort after all others; of
repeated rows with one id a single row is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import power_of_two, settle

SPACE = r"[\x20\x09-\x0D]+"
PROBES = 3


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _positions(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in range(PROBES)]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the filter positions that at least two rows of ``digests(d)`` set."""
    spots = digests.select(F.explode(F.array_distinct(F.array(*_positions(F.col("d"), bits)))).alias("p"))
    repeated = spots.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("p"), F.lit(64)).cast("int"))
    return repeated.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(one).alias("mask"))


def _maybe_repeated(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` with a column ``maybe``: whether all positions of its digest are in the filter."""
    hit = F.lit(True)
    spots = rows.withColumns({f"p{k}": p for k, p in enumerate(_positions(F.col("d"), bits))})
    for k in range(PROBES):
        side = F.broadcast(words.select(F.col("word").alias(f"w{k}"), F.col("mask").alias(f"m{k}")))
        spots = spots.join(side, F.floor(F.col(f"p{k}") / 64) == F.col(f"w{k}"), "left")
        bit = F.call_function("shiftright", F.coalesce(F.col(f"m{k}"), F.lit(0).cast("bigint")), F.pmod(F.col(f"p{k}"), F.lit(64)).cast("int"))
        hit = hit & (bit.bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return spots.withColumn("maybe", hit).select(*rows.columns, "maybe")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 2**26) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest id among the equal texts and ``kept`` marks the
    one row that stays.  Other columns of ``docs`` are not read.
    """
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("d"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    bits = power_of_two(16 * rows.count(), 2**16, max_filter_bits)
    words = settle(repeat_filter(rows.select("d"), bits))
    tested = _maybe_repeated(rows, words, bits)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = settle(tested.where("maybe").groupBy("d").agg(F.count(F.lit(1)).alias("group_size"), F.min(place).alias("first")).where("group_size > 1"))
    suspects = tested.where("maybe").join(groups, "d", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("d")).alias("text_sha256"),
    )
    alone = tested.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("d")).alias("text_sha256")
    )
    return alone.unionByName(suspects)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 2**26) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    Rows that the filter proves unique are passed on where they are.  Possibly
    repeated ones are reduced to their first row by a partial aggregate in each
    task, so a group of any size sends one row a task.
    """
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith(("map", "void"))]))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), order.alias("place"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("d"))
    digests = settle(rows.select("d"))
    bits = power_of_two(16 * digests.count(), 2**16, max_filter_bits)
    words = settle(repeat_filter(digests, bits))
    tested = _maybe_repeated(rows, words, bits)
    firsts = tested.where("maybe").groupBy("d").agg(F.min_by("whole", "place").alias("whole"))
    return tested.where("not maybe").select("whole.*").unionByName(firsts.select("whole.*"))
