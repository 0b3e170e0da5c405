from __future__ import annotations

import pytest

from weft.functions.predicates import Compare
from weft.sources.toggled_csv import Malformed, read, records, value
from weft.types import DataType, struct

CASES = [
    ("", None), ('""', None), ('"a\\"b"', 'a"b'), ('"a\\\\b"', "a\\b"), ('"a\\nb"', "a\\nb"), ("a\\b", "a\\b"), ('"l1\nl2"', "l1\nl2"),
    ('"  x"', "  x"), ("  y ", "  y "), ('"a""b"', "ab"), ('ab"c,d"e', "abc,de"),
]


@pytest.mark.parametrize("text,want", CASES)
@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", ""])
def test_fields(text, want, end):
    (row,) = records(f"7,{text}{end}")
    assert row[0] == "7" and value(row[1], DataType.VARCHAR) == want


def test_records():
    assert list(records("1,2\r\n3,4\n\n5,6")) == [["1", "2"], ["3", "4"], [""], ["5", "6"]]
    assert list(records("1\n\n2\n")) == [["1"], [""], ["2"]] and list(records("\r\r\n\n")) == [[""]] * 3 and list(records("")) == []
    for text in ("1,2,\n3,4\n", "1,2,\n\n", '1,2,""\n'):
        with pytest.raises(Malformed, match="does not end"):
            list(records(text, ",", True))
    assert list(records('"a""b","c\\",d"e"\n', escape='"')) == [['a"b', "c\\", "de"]]
    assert list(records("1|2|\n3|4|\n", "|", True)) == [["1", "2"], ["3", "4"]]
    with pytest.raises(Malformed):
        list(records('1,"a\n'))


@pytest.mark.parametrize("text,want", [("12abc", 12), ("-5", -5), ("2147483647", 2**31 - 1)])
def test_numbers(text, want):
    assert value(text, DataType.INT32) == want


@pytest.mark.parametrize("text", [" 12", "+5", "2147483648", "abc", "-"])
def test_bad_numbers(text):
    with pytest.raises(Malformed):
        value(text, DataType.INT32)


def test_table(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'k,v,d\n1,"a""b",1.5x\n2,,\n12abc,\xc3\xa9,-2e3\n')
    schema = struct(("k", DataType.INT32), ("v", DataType.VARCHAR), ("d", DataType.FP64))
    got = read(spark, str(tmp_path / "t.csv"), schema, header=True).collect()
    assert [tuple(r) for r in got] == [(1, "ab", 1.5), (2, None, None), (12, "é", -2000.0)]
    assert read(spark, str(tmp_path / "t.csv"), schema, Compare("k", ">", 1), header=True).count() == 2
    (tmp_path / "one.csv").write_bytes(b"1\n\n2\n")
    one = struct(("k", DataType.INT32))
    assert [r.k for r in read(spark, str(tmp_path / "one.csv"), one).collect()] == [1, None, 2]
    with pytest.raises(Exception, match="fields, not"):
        read(spark, str(tmp_path / "t.csv"), struct(("k", DataType.VARCHAR)), header=True).collect()
