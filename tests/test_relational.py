"""Every relational query against DuckDB, the unit cases of the plan API, and the null matrix."""

from __future__ import annotations

import itertools
from pathlib import Path

import duckdb
import pytest

from weft.compare import same_rows
from weft.functions.predicates import Between, Compare, In, IsNull, Like, Not, where
from weft.operators.relational import oracle_sql, queries
from weft.plans.explain_json import UnsupportedPlan, run_plan
from weft.plans.joingraph import DisconnectedJoin, JoinGraph
from weft.plans.plan import Plan, execute
from weft.plans.sql import UnsupportedSQL, parse, run_sql
from weft.sources.tables import TABLES, read_csv
from weft.types import DataType, struct

SF = "/root/testdata/sf0.001"
I, L, D, S = DataType.INT32, DataType.INT64, DataType.FP64, DataType.VARCHAR


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_against_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def two(spark, left, right, schema, lo, ro, lk, rk, out, build_left=True):
    p = Plan()
    a = p.add_scan(p.add_input(spark.createDataFrame(left, schema)), lo)
    b = p.add_scan(p.add_input(spark.createDataFrame(right, schema)), ro)
    p.root = p.add_join(a, b, lk, rk, out, build_left)
    return execute(spark, p, honor_build_side=True)


KEYS = [
    ([], [], []),
    ([1], [1], [(1, 1)]),
    ([1, 2, 3], [1, 2, 3], [(1, 1), (2, 2), (3, 3)]),
    ([1, 2, 3], [4, 5, 6], []),
    ([1, 1, 2, 3], [1, 1, 2, 3], [(1, 1)] * 4 + [(2, 2), (3, 3)]),
    ([1, 1, None, 2, 3], [1, 1, None, 2, 3], [(1, 1)] * 4 + [(2, 2), (3, 3)]),
    ([0, 5], [0, 0], [(0, 0), (0, 0)]),
]


@pytest.mark.parametrize("left,right,want", KEYS)
@pytest.mark.parametrize("kind,cast", [(I, int), (L, int), (D, float), (S, str)])
def test_plan_keys(spark, left, right, want, kind, cast):
    rows = lambda xs: [(None if x is None else cast(x),) for x in xs]
    schema = struct(("k", kind))
    out = two(spark, rows(left), rows(right), schema, [(0, kind)], [(0, kind)], 0, 0, [(0, kind), (1, kind)])
    assert sorted(map(tuple, out.collect())) == sorted((cast(a), cast(b)) for a, b in want)
    assert out.columns == ["c0", "c1"]


@pytest.mark.parametrize("build_left", [True, False])
def test_plan_columns(spark, build_left):
    rows = [(1, "xxx"), (1, "yyy"), (None, "zzz"), (2, "uuu"), (3, "vvv")]
    out = two(spark, rows, rows, struct(("k", I), ("s", S)), [(0, I)], [(1, S), (0, I)], 0, 1, [(0, I), (2, I), (1, S), (1, S)], build_left)
    want = [(1, 1, s, s) for s in ("xxx", "yyy")] * 2 + [(2, 2, "uuu", "uuu"), (3, 3, "vvv", "vvv")]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_plan_nan_keys_match_nothing(spark):
    out = two(spark, [(float("nan"),), (0.0,)], [(float("nan"),), (-0.0,)], struct(("k", D)), [(0, D)], [(0, D)], 0, 0, [(0, D)])
    assert [tuple(r) for r in out.collect()] == [(0.0,)]


def test_plan_faults(spark):
    df = spark.createDataFrame([(1, "a")], struct(("k", I), ("s", S)))
    p = Plan()
    a, b = (p.add_scan(p.add_input(df), [(0, I), (1, S)]) for _ in range(2))
    p.root = p.add_join(a, b, 0, 1, [(0, I)])
    with pytest.raises(TypeError):
        execute(spark, p)
    p.nodes[-1] = p.nodes[-1].__class__(a, a, 0, 0, ((0, I),))
    with pytest.raises(ValueError):
        execute(spark, p)


NULLS = [(1, "ab"), (2, None), (None, "a%b"), (5, "a\\b"), (None, None), (0, "")]
MATRIX = [
    (Compare("i", "=", 1), [0]), (Compare("i", "!=", 1), [1, 3, 5]), (Compare("i", "<", 2), [0, 5]), (Compare("i", "<=", 2), [0, 1, 5]),
    (Compare("i", ">", 1), [1, 3]), (Compare("i", ">=", 1), [0, 1, 3]), (Between("i", 1, 2), [0, 1]), (In("i", (0, 5)), [3, 5]),
    (IsNull("i"), [2, 4]), (IsNull("s", True), [0, 2, 3, 5]), (Like("s", "a%b"), [0, 2, 3]), (Like("s", "a\\_"), [3]), (Like("s", "a_"), [0]),
    (Like("s", "a%", True), [5]), (Not(Compare("i", "=", 1)), [1, 3, 5]), (Compare("i", "=", 1) | IsNull("s"), [0, 1, 4]), (Compare("s", "<", "ab"), [2, 3, 5]),
]


@pytest.mark.parametrize("predicate,want", MATRIX, ids=[str(p) for p, _ in MATRIX])
def test_null_matrix(spark, predicate, want):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(NULLS)], struct(("i", I), ("s", S), ("n", I)))
    assert sorted(r.n for r in where(df, predicate).collect()) == want


def test_two_valued_not(spark):
    df = spark.createDataFrame(NULLS, struct(("i", I), ("s", S)))
    assert where(df, Not(Compare("i", "=", 1)), "two_valued").count() == 5


@pytest.mark.parametrize("predicate", [Compare("i", "=", "x"), Compare("s", "=", 1), Compare("i", "=", 2**40), Like("i", "%"), Compare("i", "=", 1.5)])
def test_literal_types(spark, predicate):
    df = spark.createDataFrame(NULLS, struct(("i", I), ("s", S)))
    with pytest.raises(TypeError):
        where(df, predicate)


def test_any_order_same_rows(spark):
    mk = lambda col, n: spark.range(n).selectExpr(f"cast(id % 4 as int) as {col}", "id as v")
    g = JoinGraph({a: mk("k", n) for a, n in (("a", 5), ("b", 6), ("c", 7))}, equal=[(("a", "k"), ("b", "k")), (("b", "k"), ("c", "k"))])
    names = ["a__v", "b__v", "c__v"]
    want = g.plan().select(*names)
    for x, y, z in itertools.permutations("abc"):
        f = frozenset
        got = g.join([(f(x), f(y)), (f(x + y), f(z))]).select(*names)
        assert same_rows(want, got)
    assert not same_rows(want, want.union(want.limit(1)))


def test_cyclic_conditions_all_hold(spark):
    t = spark.range(8).selectExpr("id % 2 as x", "id % 4 as y", "id as v")
    g = JoinGraph({"a": t, "b": t}, equal=[(("a", "x"), ("b", "x")), (("a", "y"), ("b", "y"))])
    assert g.plan().count() == 16
    assert JoinGraph({"a": t}, equal=[(("a", "x"), ("a", "v"))]).plan().count() == 2
    with pytest.raises(DisconnectedJoin):
        JoinGraph({"a": t, "b": t}).plan()


def test_sql_faults():
    schemas = {"t": ["a", "b"], "u": ["a", "c"]}
    for text in ("select * from t", "select a from t, u", "select t.a from t, u where t.a < u.a", "select b from t, u where (b = 1 or c = 2)", "select z from t", "select a+1 from t", "select t.a from t, t"):
        with pytest.raises(UnsupportedSQL):
            parse(text, schemas)
    q = parse("SELECT MIN(x.b) AS m FROM t AS x, u y WHERE x.a = y.a AND c IN ('it''s', 'z') AND NOT (b > 3) AND c NOT LIKE '%q';", schemas)
    assert q.tables == {"x": "t", "y": "u"} and q.select == [("min", [("x", "b")], "m")] and len(q.equal) == 1


def test_raw_unwraps_functions(spark):
    t = {"t": spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")}
    assert run_sql(spark, "select min(b) as m from t", t, raw=True).count() == 2
    assert run_sql(spark, "select min(b) as m from t", t, order="greedy").collect()[0].m == 2


def test_explain_faults(spark):
    t = {"t": spark.createDataFrame([(1,)], "a int"), "u": spark.createDataFrame([(1,)], "b int")}
    scan = lambda a: {"Node Type": "Seq Scan", "Alias": a}
    with pytest.raises(UnsupportedPlan):
        run_plan("select a from t, u where a = b", {"Node Type": "Nested Loop", "Plans": [scan("t"), scan("u")]}, t)
    agg = {"Node Type": "Aggregate", "Plans": [{"Node Type": "Hash Join", "Plans": [scan("u"), {"Node Type": "Hash", "Plans": [scan("t")]}]}]}
    assert run_plan("select min(a) as m from t, u where a = b", agg, t).collect()[0].m == 1


def test_csv(spark, tmp_path: Path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'1,\n2,""\n3,"a\\"b"\n4,"a\\\\b"\n5,"l1\nl2"\n6,  y \n,"x,y"\n8,a\\b\n')
    df = read_csv(spark, str(path), struct(("i", I), ("s", S)))
    assert [tuple(r) for r in df.collect()] == [(1, None), (2, None), (3, 'a"b'), (4, "a\\b"), (5, "l1\nl2"), (6, "  y "), (None, "x,y"), (8, "a\\b")]
    assert read_csv(spark, str(path), struct(("i", I), ("s", S)), Compare("i", ">", 5)).count() == 2
    for bad in (b"12abc,x\n", b"1,2,3\n", b"2147483648,x\n"):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="MALFORMED|malformed|Malformed|FAILED_READ"):
            read_csv(spark, str(path), struct(("i", I), ("s", S))).collect()
