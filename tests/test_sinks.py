"""Tables written as pages and as text, and statements read from files."""

import pytest

from weft.context import show
from weft.plans.sql import run_file
from weft.sources.pages import read_pages, write_pages
from weft.sources.tables import write_text

SCHEMA = "i int, l long, d double, s string"
ROWS = [(1, 1 << 40, 0.5, "x"), (None, None, None, None), (2, -1, float("inf"), ""), (3, 0, -0.0, "é" * 9000), (4, 5, 1e300, 'a|"b\\\nc')] * 500


def test_pages_of_a_table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    write_pages(df, f"{tmp_path}/t")
    back = read_pages(spark, f"{tmp_path}/t", df.schema)
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_pages_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    write_pages(df, f"{tmp_path}/t")
    assert read_pages(spark, f"{tmp_path}/t", df.schema).collect() == []


def test_pages_refuse_other_types(spark, tmp_path):
    with pytest.raises(ValueError, match="b boolean"):
        write_pages(spark.createDataFrame([(True,)], "b boolean"), f"{tmp_path}/t")


def test_text_is_what_show_says(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a|"b\\\nc', 0.5), (None, None, None), (2, "", 1.0)], "i int, `s.t` string, d double").coalesce(1)
    write_text(df, f"{tmp_path}/t")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert lines == ['1|"a|\\"b\\\\\\nc"|0.5', "NULL|NULL|NULL", '2|""|1.0']
    assert show(df).split("\n") == lines


def test_statement_of_a_file(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT min(b.w) AS w\nFROM ta AS a, tb AS b\nWHERE a.k = b.k AND a.v > 1;\n")
    tables = {"ta": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int"), "tb": spark.createDataFrame([(1, 5), (2, 8), (3, 7)], "k int, w int")}
    for order in ("catalyst", "greedy", "greedy_exact"):
        assert [tuple(r) for r in run_file(spark, f"{tmp_path}/q.sql", tables, order=order).collect()] == [(7,)]
