r"""CSV in which a quote anywhere opens or closes quoting, read as written.

Spark's reader gives a quote its meaning only at the ends of a field. Here it only toggles:
``"a""b"`` is ``ab`` and ``ab"c,d"e`` is ``abc,de``. Inside quotes ``\"`` and ``\\`` stand for
the quote and the backslash, any other backslash for itself; outside it is a plain character.
With ``escape='"'`` the dialect is the usual one instead: inside quotes ``""`` is a quote, and a
backslash is always plain. Lines end with ``\n``, ``\r`` or both; an empty line is a record of one
empty field. An empty field is NULL for every type. A number is read
as far as it goes (``12abc`` is 12); one that has no digits, begins with ``+`` or a space, or is
out of range fails the query, as does a record of another length or, where a separator has to
end every record, one without it.

A quoted line break can be anywhere, so a file is read by one task; convert large ones once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weft.functions.predicates import Predicate, where
from weft.types import DataType

_INT = re.compile(r"-?\d+")
_REAL = re.compile(r"-?(?:inf(?:inity)?|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.IGNORECASE)
#: Plain text up to something that may matter; inside quotes separators and line breaks do not.
_OUTSIDE, _INSIDE = re.compile(r'[^",\r\n]+'), {"\\": re.compile(r'[^"\\]+'), '"': re.compile(r'[^"]+')}


class Malformed(ValueError):
    """A record of another length than the schema, or a field that is no number."""


def records(text: str, separator: str = ",", trailing_separator: bool = False, escape: str = "\\") -> Iterator[list[str]]:
    """The records of a file as lists of texts; ``escape`` is the backslash or the quote."""
    outside = _OUTSIDE if separator == "," else re.compile(rf'[^"{re.escape(separator)}\r\n]+')
    inside = _INSIDE[escape]
    row: list[str] = []
    field: list[str] = []
    at, quoted, begun, closed = 0, False, False, False  # closed: the last character was a separator

    def done() -> list[str]:
        if not trailing_separator:
            return [*row, "".join(field)]
        if not closed:
            raise Malformed("a record does not end with a separator")
        return row

    while at < len(text):
        m = (inside if quoted else outside).match(text, at)
        if m:
            field.append(m[0])
            at, begun, closed = m.end(), True, False
            continue
        c = text[at]
        at += 1
        if quoted and c == escape and text[at : at + 1] in {'"', escape}:
            field.append(text[at])
            at += 1
        elif c == '"':
            quoted, begun, closed = not quoted, True, False
        elif quoted:
            field.append(c)
        elif c == separator:
            row.append("".join(field))
            field, begun, closed = [], True, True
        else:
            at += c == "\r" and text[at : at + 1] == "\n"
            yield done()
            row, field, begun, closed = [], [], False, False
    if quoted:
        raise Malformed("a quote is not closed")
    if begun:
        yield done()


def value(field: str, kind: DataType):
    """A field's value, by the rules above."""
    if not field:
        return None
    if kind is DataType.VARCHAR:
        return field
    m = (_REAL if kind is DataType.FP64 else _INT).match(field)
    if not m:
        raise Malformed(f"{field!r} is no {kind.value}")
    out = float(m[0]) if kind is DataType.FP64 else int(m[0])
    if kind is not DataType.FP64 and not kind.accepts(out):
        raise Malformed(f"{field!r} is out of the range of {kind.value}")
    return out


def read(spark: SparkSession, path: str, schema: T.StructType, predicate: Predicate | None = None, header: bool = False, separator: str = ",", trailing_separator: bool = False, escape: str = "\\") -> DataFrame:
    """A table of CSV files in this dialect."""
    names, kinds = schema.fieldNames(), [DataType.of(f.dataType) for f in schema.fields]
    arrow = {DataType.INT32: pa.int32(), DataType.INT64: pa.int64(), DataType.FP64: pa.float64(), DataType.VARCHAR: pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for content in b["content"].to_pylist():
                rows: list[list] = []
                for n, r in enumerate(records(content.decode(), separator, trailing_separator, escape)):
                    if len(r) != len(kinds):
                        raise Malformed(f"record {n + 1} has {len(r)} fields, not {len(kinds)}")
                    if n or not header:
                        rows.append([value(x, k) for x, k in zip(r, kinds, strict=True)])
                    if len(rows) == 5000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return where(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema), predicate)
