"""Comparison of two results as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Same column types in order and the same rows with the same counts; NULL equals NULL. Distributed."""
    if [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
        return False
    names = [f"c{i}" for i in range(len(a.columns))]
    counted = a.toDF(*names).withColumn("side", F.lit(1)).unionAll(b.toDF(*names).withColumn("side", F.lit(-1)))
    return counted.groupBy(*names).agg(F.sum("side").alias("side")).where("side != 0").isEmpty()
