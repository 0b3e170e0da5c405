"""The engine's four column types and their Spark counterparts."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    INT32 = "int"
    INT64 = "bigint"
    FP64 = "double"
    VARCHAR = "string"

    @property
    def spark(self) -> T.DataType:
        return {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}[self.value]

    @classmethod
    def of(cls, spark_type: T.DataType) -> DataType:
        """The engine type of a Spark type; others are refused."""
        try:
            return cls(spark_type.simpleString())
        except ValueError:
            raise TypeError(f"{spark_type.simpleString()} is none of int, bigint, double, string") from None

    def accepts(self, value: object) -> bool:
        """Whether a literal may be compared with a column of this type."""
        if isinstance(value, bool):
            return False
        if self is DataType.VARCHAR:
            return isinstance(value, str)
        if self is DataType.FP64:
            return isinstance(value, (int, float))
        bits = 31 if self is DataType.INT32 else 63
        return isinstance(value, int) and -(2**bits) <= value < 2**bits


def struct(*columns: tuple[str, DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind.spark, True) for name, kind in columns])
