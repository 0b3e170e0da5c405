from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_lm import words
from weft.llm import lm
from weft.llm.queries import queries


def brute(rows, order):
    """The scores by exact counts, every order smoothed by the one below."""
    padded = [(i, ["start"] * (order - 1) + words(t), train) for i, t, train in rows]
    counts, contexts = Counter(), Counter()
    for _, w, train in padded:
        for at in range(order - 1, len(w) if train else 0):
            for k in range(order):
                counts[tuple(w[at - k : at + 1])] += 1
                contexts[tuple(w[at - k : at])] += 1
    n, v = contexts[()], sum(len(g) == 1 for g in counts)
    out = []
    for i, w, _ in padded:
        total = 0.0
        for at in range(order - 1, len(w)):
            p = (counts[(w[at],)] + 0.1) / (n + 0.1 * (v + 1))
            for k in range(1, order):
                p = (counts[tuple(w[at - k : at + 1])] + lm.MU * p) / (contexts[tuple(w[at - k : at])] + lm.MU)
            total += math.log10(p)
        out.append((i, len(w) - order + 1, total))
    return out


def check(got, want, order):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got, want = sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key), sorted(want, key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[2] - w[2]) <= 4e-4 * (order - 1) * w[1] + 1e-6


def odd():
    rows = [(1, "a b a b a B\tc", True), (2, None, True), (3, "", False), (4, " \n ", True), (5, "a " * 3000, True), (5, "a " * 3000, True), (6, "never seen é", False), (None, "a b", False)]
    return rows + [(k, f"the w{k % 7} of w{k % 3} in w{k % 5}", k % 4 > 0) for k in range(10, 90)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK", 40)
    monkeypatch.setattr(lm, "SPREAD", 3)
    df = spark.createDataFrame(odd(), "doc_id long, text string, train boolean")
    check(lm.score(df, F.col("train"), order).collect(), brute(odd(), order), order)


def test_the_query_looks_two_words_back(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op5_lm"](spark, sf).collect()
    check(got, brute(rows, 3), 3)
    two = {i: s for i, _, s in brute(rows, 2)}
    assert sum(abs(r.score - two[r.doc_id]) > 1e-3 * r.n_tokens for r in got) > 100
