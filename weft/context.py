"""A session's tables, caches and timed execution of plans and SQL."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weft.functions.predicates import Predicate
from weft.plans import explain_json, plan, sql
from weft.sources.tables import ParquetTables, read_csv


class Context:
    """Tables by name, an optional cache of them, and the run time of what was executed.

    ``with Context(spark, folder) as c:`` releases cached tables at the end.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.microseconds = spark, 0
        self.tables: dict[str, DataFrame] = ParquetTables(spark, folder) if folder else {}
        self.tables.update(tables or {})
        self._cached: list[DataFrame] = []

    def __enter__(self) -> Context:
        return self

    def __exit__(self, *failure: object) -> None:
        self.close()

    def close(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def cache(self, *names: str) -> None:
        """Keeps base tables in executor memory and disk from their first use on."""
        for name in names:
            self.tables[name] = self.tables[name].persist()
            self._cached.append(self.tables[name])

    def add_csv(self, name: str, path: str, schema: T.StructType, predicate: Predicate | None = None, **how) -> DataFrame:
        self.tables[name] = read_csv(self.spark, path, schema, predicate, **how)
        return self.tables[name]

    def execute(self, p: plan.Plan, names: list[str] | None = None) -> DataFrame:
        return plan.execute(self.spark, p, names)

    def sql(self, text: str, raw: bool = False, order: str = "catalyst") -> DataFrame:
        return sql.run_sql(self.spark, text, self.tables, raw, order)

    def explained(self, text: str, tree: str | dict, raw: bool = False) -> DataFrame:
        return explain_json.run_plan(text, tree, self.tables, raw)

    def timed(self, df: DataFrame) -> int:
        """Runs a result without fetching it; microseconds, which also add up in ``microseconds``."""
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took = int((time.perf_counter() - began) * 1e6)
        self.microseconds += took
        return took


def show(df: DataFrame, limit: int = 20) -> str:
    """The first rows as text: ``|`` between fields, strings quoted and escaped, NULL for nulls."""

    def field(x: object) -> str:
        if x is None:
            return "NULL"
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if isinstance(x, str) else str(x)

    return "\n".join("|".join(map(field, row)) for row in df.take(limit))
