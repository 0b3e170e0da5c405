"""What a worker gets at a time, and makes Python objects of at a time."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import bpe
from weft.llm.queries import vocabulary
from weft.llm.shared import cut, trimmed


def rows_in_batches(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    large = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1000000)").alias("text"))
    return [r.n for r in large.mapInArrow(count, "n long").collect()]


@pytest.mark.parametrize("step", [lambda df: bpe.encode(df, vocabulary()), cut])
def test_batches_of_large_texts_are_small(spark, step):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        step(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        got = rows_in_batches(spark)
    finally:
        spark.conf.set(name, before)
    assert sum(got) == 40 and max(got) <= 10


def test_arrow_gives_memory_back_when_a_task_ends(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(trimmed()(lambda batches: iter(batches))(iter([1, 2]))) == [1, 2] and calls == [1]
