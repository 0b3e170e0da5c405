from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.llm import lm
from weft.llm.queries import queries
from weft.llm.shared import LOWER


def words(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def brute(rows, order=2):
    """doc_id, text, train -> n_tokens, n_known, N, base, score by exact counts, each order smoothed by the one below."""
    grams = [Counter() for _ in range(order + 1)]
    for _, t, train in rows:
        if train:
            w = ["start"] * (order - 1) + words(t)
            for at in range(order - 1, len(w)):
                for k in range(order + 1):
                    grams[k][tuple(w[at - k + 1 : at + 1])] += 1
    contexts = [Counter() for _ in range(order)]
    for k in range(1, order):
        for gram, c in grams[k + 1].items():
            contexts[k][gram[:-1]] += c
    c = Counter({g[0]: x for g, x in grams[1].items()})
    n, v = sum(c.values()), len(c)
    out = []
    for i, t, _ in rows:
        w = ["start"] * (order - 1) + words(t)
        base = score = 0.0
        for at in range(order - 1, len(w)):
            p = (c[w[at]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                p = (grams[k + 1][tuple(w[at - k : at + 1])] + lm.MU * p) / (contexts[k][tuple(w[at - k : at])] + lm.MU)
            score += math.log10(p)
        own = w[order - 1 :]
        out.append((i, len(own), sum(c[x] > 0 for x in own), n, base, score))
    return out


def check(got, want, order=2):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert abs(g[5] - w[5]) <= 4e-4 * (order - 1) * w[1] + 1e-6


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op5_lm"](spark, sf).collect()
    assert all(r.held_out != t for r, t in zip(sorted(got), [t for *_, t in sorted(rows)], strict=True))
    check(got, brute(rows, lm.ORDER), lm.ORDER)


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 40)
    monkeypatch.setattr(lm, "SPREAD", 3)
    rows = [(1, "a b a b a B\tc", True), (2, None, True), (3, "", False), (4, " \n ", True), (5, "a " * 5000, True), (5, "a " * 5000, True), (6, "never seen é", False), (None, "a b", False), (7, "x" * 50_000, True)]
    rows += [(k, f"the w{k % 7} of w{k % 3}", k % 4 > 0) for k in range(10, 90)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, train boolean, block string, n int")
    check(lm.score(df, F.col("train")).collect(), brute(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, F.lit(True)).count() == 0


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = lm.score(df, F.lit(False)).collect()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(r.base_score) == pytest.approx(0.0)
