"""Scan/join plans over streams: the same plan, with streaming inputs.

An inner equi-join of a stream with tables is stateless; a join of two streams keeps state,
which a watermark on both sides bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weft.functions.predicates import Predicate, where


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, predicate: Predicate | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return where(reader.parquet(folder), predicate)


def drain(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived, exactly once, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
