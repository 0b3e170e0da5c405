from __future__ import annotations

import zlib
from collections import defaultdict

from weft.llm import sharding
from weft.llm.queries import queries

SCHEMA = "doc_id long, text string, shard int, h long"


def check(got, docs, shards=24):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    total, most = sum(r.size for r in got), max((r.size for r in got), default=0)
    for s in range(shards):
        assert abs(sum(r.size for r in by[s]) - total / shards) <= most + 1
    return by


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(queries()["op6_shards"](spark, sf).collect(), docs)


def test_hot_copies_are_split_and_few_texts_straddle(spark, monkeypatch):
    docs = [(i, "copy of one text") for i in range(3000)] + [(i, f"text {i}" * (i % 7)) for i in range(3000, 6000)] + [(6000, "long" * 20_000)]
    rows = [(i, t, 1, 1) for i, t in docs]
    by = check(sharding.assign(spark.createDataFrame(rows, SCHEMA)).collect(), docs)
    places = defaultdict(set)
    for s, own in by.items():
        for r in own:
            places[dict(docs)[r.doc_id]].add(s)
    assert sum(len(p) > 1 for t, p in places.items() if t != "copy of one text") <= 24


def test_odd_rows(spark):
    docs = [(None, None), (None, ""), (1, None), (1, None), (2, "é"), (2, "é"), (3, "\U0001f600")]
    check(sharding.assign(spark.createDataFrame([(i, t, 0, 0) for i, t in docs], SCHEMA)).collect(), docs)
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overfull_ranges_are_subdivided(spark):
    rows = sharding.records(spark.createDataFrame([(i, "same") for i in range(5000)] + [(i, str(i)) for i in range(5000, 5100)], "doc_id long, text string"))
    bounds, sums = sharding.splitters(rows, 5000 * 12 + 100 * 12)
    assert sum(n for _, n in sums.values()) == 5100
    assert max(n for _, n in sums.values()) <= 3 * 5100 / sharding.MIN_RANGES


def test_write(spark, tmp_path):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat('x', cast(id as int)) as text", "id % 3 as extra")
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and set(back.columns) == {"doc_id", "text", "extra", "shard", "slot"}
