"""op5's slices: what has asked or been answered leaves the disk before the next slice, and none is lost."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_lm import brute, check
from weft.llm import lm, shared


def files(table) -> int:
    return len([*Path(table.path.removeprefix("file:")).rglob("*.parquet")])


@pytest.mark.parametrize("order", [2, 3])
def test_slices_leave_the_disk_one_by_one(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "SLICE_BYTES", 500)
    made, left = [], []

    def cut(df, name="cut"):
        out = shared.cut(df, name)
        made.append((name, out))
        left.append((name, sum(files(t) for n, t in made if n == "blocks"), sum(files(t) for n, t in made if n == "asked")))
        return out

    monkeypatch.setattr(lm, "cut", cut)
    rows = [(k, f"the w{k % 7} of w{k % 3} in w{k % 5}", k % 4 > 0) for k in range(400)]
    rows += [(None, "the w1", False), (3, "the w3", True), (401, None, True), (402, "", True), (403, "the w9 " * 300, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(8)  # a block each
    check(lm.score(df, F.col("train"), order).collect(), brute(rows, order), order)
    names = [n for n, *_ in left]
    end = names.index("sums")
    asking = [blocks for n, blocks, _ in left[end - lm.SLICES : end]]
    assert names[end - lm.SLICES : end] == ["asked"] * lm.SLICES
    assert asking == [8, 6, 4, 2]  # a slice's blocks go once they have asked
    answering = [asked for n, _, asked in left[end:] if n != "scores"]
    assert len(answering) == lm.SLICES
    assert all(x > y > 0 for x, y in zip(answering, answering[1:], strict=False))  # pairs go once they have been answered
    assert [t for _, t in made if files(t)] == [made[-1][1]]


def test_slices_get_equally_many_blocks(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(40)], "text": ["a"] * 40, "train": [True] * 40})
    blocks = [x for b in lm._blocks(iter([batch])) for x in b["block"].to_pylist()]
    assert len(set(blocks)) == 40
    assert [sum(x % lm.SLICES == at for x in blocks) for at in range(lm.SLICES)] == [10] * lm.SLICES
