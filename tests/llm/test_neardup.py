from __future__ import annotations

import numpy as np

from weft.llm import neardup
from weft.llm.components import components
from weft.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, rep int"


def brute(ids, x, threshold=0.9):
    x = np.asarray(x, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, label = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = sorted(queries()["op1_embedding_neardup"](spark, sf).collect())
    assert [r.vec_id for r in got] == [r.vec_id for r in rows]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links <= m for r, m in zip(got, n, strict=True))
    assert sum(r.n_links for r in got) >= 0.98 * n.sum()
    assert sum(r.component_id == c for r, c in zip(got, label, strict=True)) >= 0.99 * len(got)


def test_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 32)
    r = np.random.default_rng(1)
    centre = r.standard_normal(16)
    x = [centre + 0.12 * r.standard_normal(16) for _ in range(300)] + [r.standard_normal(16) for _ in range(200)] + [centre] * 40
    x = np.array(x, dtype=np.float32)
    n, label = brute(range(len(x)), x)
    got = sorted(neardup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), recall=0.9999).collect())
    assert sum(g.n_links for g in got) >= 0.995 * n.sum()
    assert all(g.n_links <= m for g, m in zip(got, n, strict=True))
    assert [g.component_id for g in got] == label.tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (11, [-1.0, -1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 10, 11):
        assert got[i] == (0, i, True)
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[9] == (2, 7, False)
    assert got[None][0] == 0
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (6, [1.0, 0.01, 0.0]), (5, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.01]), (8, [-1.0, 0.0, 0.0])]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), recall=0.999999).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(4, 1, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (8, 0, 8, True), (9, 1, 4, False), (9, 1, 5, False)]


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (300, 400)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (None, 5), (7, None)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61))
    assert {got[k] for k in (100, 200, 300, 400)} == {100}
    assert {got[k] for k in range(1000, 1400)} == {1000}
    assert len(got) == 61 + 4 + 400
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
