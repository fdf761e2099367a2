"""Lineage cuts that outlive an executor.

Intermediate results go to the folder in ``spark.checkpoint.dir``, which the
driver and all executors share.  A folder of our own is set only where the
session names none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that are broadcast, at most; more of them are joined by a shuffle.
FEW = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder with its file system; set to a temporary one if there is none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vecstrata-"))
        held = sc._jsc.sc().getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(named or held.get())
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and the table's path.

    A checkpoint keeps the size estimate of the plan that made it, and joins multiply
    estimates, so in a loop of joins their digits grow exponentially and fill the driver;
    a table is as large as its files.
    """
    path = fresh_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Settled rows of a few numbers as a side of a join: broadcast up to ``most`` of them, else for a sorted merge."""
    return F.broadcast(rows) if rows.count() <= (FEW if most is None else most) else rows.hint("merge")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own below the shared folder; the caller creates it."""
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def power_of_two(at_least: float, low: int, high: int) -> int:
    """The smallest power of two not under ``at_least``, kept within [low, high]."""
    n = low
    while n < at_least and n < high:
        n *= 2
    return n
