"""Parquet and CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.predicates import Predicate, where

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class ParquetTables(dict):
    """Tables of a folder, opened when first used: only those that a query names are touched."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES):
        super().__init__()
        self.spark, self.folder, self.names = spark, folder, names

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, predicate: Predicate | None = None, header: bool = False, null_logic: str = "sql") -> DataFrame:
    r"""A CSV table with ``\`` as escape and quoted newlines; empty fields are NULL for every type.

    A malformed number or a record of another length fails the query. Such files cannot be
    split, so large ones are best converted once: ``read_csv(...).write.parquet(...)``.
    """
    reader = spark.read.schema(schema).options(sep=",", quote='"', escape="\\", multiLine=True, mode="FAILFAST", header=header)
    # enforced by a no-op projection: without it, column pruning would skip the parse of unused fields
    return where(reader.option("columnPruning", False).csv(path), predicate, null_logic)


def write_text(df: DataFrame, path: str) -> None:
    r"""Rows as lines of ``|``-separated fields: strings quoted, with ``\``, ``"`` and newlines escaped by ``\``, ``NULL`` for nulls."""

    def field(f: T.StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.StringType):
            for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
                c = F.replace(c, F.lit(plain), F.lit(escaped))
            c = F.concat(F.lit('"'), c, F.lit('"'))
        return F.coalesce(c.cast("string"), F.lit("NULL"))

    df.select(F.concat_ws("|", *map(field, df.schema)).alias("value")).write.text(path)
