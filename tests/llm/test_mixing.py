from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from weft.llm import mixing
from weft.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("seed", range(12))
def test_schedule_keeps_every_window(seed):
    r = random.Random(seed)
    blocks = mixing.quotas({f"s{k}": r.choice([1, 3, 50, 1000, 7777]) for k in range(r.randint(1, 40))}, 64)
    period, done = sum(blocks.values()), Counter()
    plan = mixing.schedule(blocks)
    assert [p[4] for p in plan] == list(range(period))
    for s, j, release, due, slot in plan:
        assert release <= slot < due
        done[s] += 1
        assert all(abs(done[x] - Fraction(blocks[x] * (slot + 1), period)) < 1 for x in blocks)
    assert done == Counter(blocks)


def test_against_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(oracle_sql()["op3_mixing"])
    names = [c[0] for c in want.description]
    got = queries()["op3_mixing"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_mix_follows_given_weights(spark):
    rows = [(i, "big" if i % 3 else "small", f"t{i}", 1) for i in range(3000)] + [(i, None, None, 1) for i in range(5)] + [(None, "big", "n", 1), (7, "big", "t7", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix string")
    got = mixing.mix(df, {"big": 1, "small": 3, "": 1}, block=4, period=20)
    assert got.columns[:4] == df.columns
    out = got.collect()
    assert len(out) == len(rows) and len({r.mix_place for r in out}) == len(rows)
    out.sort(key=lambda r: r.mix_place)
    head = Counter(r.source for r in out[200:1000])
    assert abs(head["small"] / head["big"] - 3) < 0.1
    slots = defaultdict(set)
    for r in out:
        slots[r.mix_slot].add(r.source)
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert all(len(s) == 1 for s in slots.values())


def test_order_is_kept_in_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 4}", "x") for i in range(500)], "doc_id long, source string, text string")
    mixing.in_order(mixing.mix(df), 5).write.parquet(str(tmp_path / "o"))
    files = sorted((tmp_path / "o").glob("*.parquet"))
    places = [p for f in files for p in spark.read.parquet(str(f)).toPandas().mix_place]
    assert len(files) > 1 and places == sorted(places)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
