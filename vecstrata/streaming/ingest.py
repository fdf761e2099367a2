"""Applying a stream of mutations to an index.

Each micro-batch is replayed in order of log offset; the manifest keeps the last
applied offset, so a batch that Spark delivers again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..index import LOG, VectorIndex


def mutation_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Log rows from Parquet files that appear below ``path``."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(path)


def ingest(index: VectorIndex, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that replays each micro-batch; ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: index.replay(batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
