"""What op5 holds on disk, and how many steps its search takes."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_lm import brute, check
from weft.llm import eliasfano, lm, shared


def test_blocks_ask_in_slices_and_are_gone_before_the_last_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 40)
    monkeypatch.setattr(lm, "SLICE_BYTES", 500, raising=False)
    made, beside = [], {}

    def cut(df, name="cut"):
        out = shared.cut(df, name)
        made.append(out)
        beside.setdefault(name, []).extend(t.path.split("/weft-")[1].split("-")[0] for t in made if Path(t.path.removeprefix("file:")).exists())
        return out

    monkeypatch.setattr(lm, "cut", cut)
    rows = [(k, f"the w{k % 7} of w{k % 3} in w{k % 5}", k % 4 > 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    check(lm.score(df, F.col("train"), 3).collect(), brute(rows, 3), 3)
    assert set(beside["sums"]) == {"asked", "sums"}  # neither blocks nor what they were told
    assert beside["sums"].count("asked") == lm.SLICES
    assert [t for t in made if Path(t.path.removeprefix("file:")).exists()] == made[-1:]


def test_successor_halves_long_ranges(monkeypatch):
    calls = []
    unpack = eliasfano.unpack
    monkeypatch.setattr(eliasfano, "unpack", lambda *a: calls.append(1) or unpack(*a))
    values = np.concatenate([np.arange(5000), [1 << 40]]).astype(np.uint64)  # all but one have equal high bits
    seek = np.array([0, 1, 2500, 4999, 5000, 1 << 40, (1 << 40) + 1], dtype=np.uint64)
    got = eliasfano.Monotone.of(values, (1 << 40) + 1).successor(seek)
    assert got.tolist() == np.searchsorted(values, seek).tolist()
    assert len(calls) < 20
