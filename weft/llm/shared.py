"""Tables in the cluster's shared folder, and small expressions that several operators use."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and upper case, as the word contracts define them.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or where that is unset one beside the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/weft-scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return top.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, of which both a worker and its executor hold several at a time."""
    known = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCHES))
    if known > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def parted(df: DataFrame, column: str) -> DataFrame:
    """Has ``cut`` write a folder for each value of the last column, so that ``drop_part`` can delete one by itself."""
    df.by = column
    return df


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    The table outlives any executor. ``table.path`` names it for ``drop``.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/weft-{name}-{uuid.uuid4().hex}"
    by = [vars(df)["by"]] if "by" in vars(df) else []
    small_batches(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table is of no use once it is written
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return parted(out, *by) if by else out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.path)


def drop_part(value: int, *tables: DataFrame) -> None:
    """Deletes what tables of ``parted`` hold beside one value; their other parts can still be read by it."""
    for t in tables:
        _delete(t.sparkSession, f"{t.path}/{vars(t)['by']}={value}")


class Tables:
    """The tables of an operator: at the end, or when it fails, all go but those that its result still reads."""

    def __init__(self):
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        out = cut(df, name)
        self.made.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        drop(*tables)
        self.made = [t for t in self.made if all(t is not x for x in tables)]

    def keep(self, *tables: DataFrame) -> None:
        self.kept += tables

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind, *_) -> None:
        drop(*(t for t in self.made if kind is not None or all(t is not x for x in self.kept)))


def release(spark: SparkSession) -> None:
    """Lets the cleaner free shuffle files of finished steps now rather than at the next collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def named(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(names: Sequence[str], *wanted: str) -> list[str]:
    """Column names like those wanted that none of ``names`` is, in whatever case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: only one of a batch's is held as Python objects."""
    for b in batches:
        for at in range(b.num_rows):
            yield from b.slice(at, 1).to_pylist()


def trimmed(forget: Callable[[], object] = lambda: None):
    """For what runs on batches: when a task ends, ``forget`` runs, and the worker's freed memory goes back.

    Workers are used again by later stages; what one keeps, all of them would pay for.
    """

    def wrap(run):
        @functools.wraps(run)
        def task(batches: Iterator) -> Iterator:
            try:
                yield from run(batches)
            finally:
                forget()
                pa.default_memory_pool().release_unused()  # Arrow's own allocator keeps what batches took
                try:
                    ctypes.CDLL(None).malloc_trim(0)
                except (AttributeError, OSError):  # another C library has no such call
                    pass

        return task

    return wrap


def interval(value: Column, splitters: Sequence, one: Column | None = None) -> Column:
    """The number of sorted splitters that are <= value, by binary search inside the expression.

    splitters: Python values, or with ``one`` (an array column of them) any orderable type.
    """
    n = len(splitters)
    if not n:
        return F.lit(0)
    table = F.array(*[F.lit(x) for x in splitters]) if one is None else one
    steps = [1 << k for k in reversed(range(n.bit_length()))]

    def step(low: Column, width: Column) -> Column:
        at = low + width
        return F.when((at <= n) & (F.get(table, F.least(at, F.lit(n)) - 1) <= value), at).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one narrow job."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0)
