from __future__ import annotations

import random

import pytest

from weft.context import Context, show
from weft.operators.relational_sql import ORACLE
from weft.plans.plan import Plan
from weft.sources import pages
from weft.sources.film_schema import SCHEMAS
from weft.types import DataType, struct


def test_context(spark, tmp_path):
    with Context(spark, "/root/testdata/sf0.001") as c:
        c.cache("nation", "region")
        want = c.sql(ORACLE["join_two_way"])
        assert c.tables["nation"].is_cached
        p = Plan()
        i, s = DataType.INT32, DataType.VARCHAR
        n, r = p.add_scan(p.add_input(c.tables["nation"]), [(1, s), (2, i)]), p.add_scan(p.add_input(c.tables["region"]), [(0, i), (1, s)])
        p.root = p.add_join(n, r, 1, 0, [(0, s), (3, s)])
        assert sorted(map(tuple, c.execute(p).collect())) == sorted(map(tuple, want.collect()))
        assert c.timed(want) > 0 and c.microseconds > 0
        (tmp_path / "t.csv").write_text('1,"a|b"\n2,\n')
        assert show(c.add_csv("t", str(tmp_path / "t.csv"), struct(("k", i), ("v", s)))) == '1|"a|b"\n2|NULL'
    assert not c._cached


def test_film_schema():
    assert len(SCHEMAS) == 21 and [f.name for f in SCHEMAS["keyword"].fields] == ["id", "keyword", "phonetic_code"]
    assert all(DataType.of(f.dataType) in (DataType.INT32, DataType.VARCHAR) and f.nullable for t in SCHEMAS.values() for f in t.fields)


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "string"])
def test_pages_round_trip(kind):
    r = random.Random(kind)
    make = {"int": lambda: r.randint(-(2**31), 2**31 - 1), "bigint": lambda: r.randint(-(2**63), 2**63 - 1), "double": lambda: r.random() * r.choice([0, -1, 1e300]), "string": lambda: r.choice(["", "é", "x" * r.randint(0, 300), "y" * r.choice([8184, 8185, 8186, 8188, 8189, 20_000])])}[kind]
    for n in (0, 1, 7, 8, 9, 3000):
        for nulls in (0.0, 0.3, 1.0):
            values = [None if r.random() < nulls else make() for _ in range(n)]
            made = list(pages.encode(values, kind))
            assert all(len(p) == pages.SIZE for p in made)
            assert pages.decode(made, kind).to_pylist() == values
