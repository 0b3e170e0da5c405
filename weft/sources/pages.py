"""The 8 KiB page format: a codec between Arrow columns and lists of pages, and tables of such pages.

Fixed values of the format: a page has 8192 bytes; it starts with the numbers of rows and of
values (16 bits each); the bitmap of present rows ends it, first row in the lowest bit.
Numbers start at byte 4 (32 bits) or 8 (64 bits), absent ones take no room. Texts have the
ends of their bytes as 16-bit numbers from byte 4, then the bytes. A text that no page can
hold with others has pages of its own, marked 0xffff and, going on, 0xfffe, with the number
of bytes in the page.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SIZE = 8192
LONG, MORE = 0xFFFF, 0xFFFE
LONGEST, LONG_BYTES = SIZE - 7, SIZE - 4
KINDS = {"int": (np.dtype("<i4"), 4), "bigint": (np.dtype("<i8"), 8), "double": (np.dtype("<f8"), 8)}


def _sealed(body: bytes, present: list[bool]) -> bytes:
    bits = np.packbits(np.array(present, dtype=np.uint8), bitorder="little").tobytes()
    return body + b"\0" * (SIZE - len(body) - len(bits)) + bits


def encode(values: Iterable, kind: str) -> Iterator[bytes]:
    """The pages of a column."""
    yield from _text_pages(values) if kind == "string" else _number_pages(values, *KINDS[kind])


def _number_pages(values: Iterable, kind: np.dtype, begin: int) -> Iterator[bytes]:
    own: list = []
    present: list[bool] = []

    def page() -> bytes:
        head = struct.pack("<HH", len(present), len(own))
        return _sealed(head + b"\0" * (begin - 4) + np.array(own, dtype=kind).tobytes(), present)

    for v in values:
        if begin + (len(own) + (v is not None)) * kind.itemsize + len(present) // 8 + 1 > SIZE:
            yield page()
            own, present = [], []
        present.append(v is not None)
        if v is not None:
            own.append(v)
    if present:
        yield page()


def _text_pages(values: Iterable) -> Iterator[bytes]:
    own: list[bytes] = []
    present: list[bool] = []
    used = 0

    def page() -> bytes:
        ends = np.cumsum([len(x) for x in own], dtype=np.int64).astype("<u2").tobytes()
        return _sealed(struct.pack("<HH", len(present), len(own)) + ends + b"".join(own), present)

    for v in values:
        data = None if v is None else v.encode()
        if data is not None and len(data) > LONGEST:
            if present:
                yield page()
                own, present, used = [], [], 0
            for at in range(0, len(data), LONG_BYTES):
                part = data[at : at + LONG_BYTES]
                body = struct.pack("<HH", MORE if at else LONG, len(part)) + part
                yield body + b"\0" * (SIZE - len(body))
            continue
        more = 0 if data is None else 2 + len(data)
        if 4 + used + more + len(present) // 8 + 1 > SIZE:
            yield page()
            own, present, used = [], [], 0
        present.append(data is not None)
        if data is not None:
            own.append(data)
            used += more
    if present:
        yield page()


def decode(pages: Iterable[bytes], kind: str) -> pa.Array:
    """The column of its pages."""
    out: list = []
    held: list[bytes] = []
    for page in pages:
        rows, n = struct.unpack_from("<HH", page)
        if kind == "string" and rows in (LONG, MORE):
            if rows == LONG and held:
                out.append(b"".join(held).decode())
                held = []
            held.append(page[4 : 4 + n])
            continue
        if held:
            out.append(b"".join(held).decode())
            held = []
        bits = np.frombuffer(page[SIZE - (rows + 7) // 8 :], dtype=np.uint8) if rows else np.empty(0, np.uint8)
        present = np.unpackbits(bits, bitorder="little")[:rows]
        if kind == "string":
            ends = np.frombuffer(page, "<u2", n, 4).tolist()
            text = page[4 + 2 * n :]
            values = iter([text[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)])
        else:
            values = iter(np.frombuffer(page, KINDS[kind][0], n, KINDS[kind][1]).tolist())
        out += [next(values) if there else None for there in present]
    if held:
        out.append(b"".join(held).decode())
    return pa.array(out, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind])


PAGES = "rows long, pages array<array<binary>>"


def _kinds(schema: T.StructType) -> list[str]:
    kinds = [f.dataType.simpleString() for f in schema]
    strange = [f"{f.name} {kind}" for f, kind in zip(schema, kinds, strict=True) if kind not in (*KINDS, "string")]
    if strange:
        raise ValueError(f"pages hold int, bigint, double and string, not {', '.join(strange)}")
    return kinds


def write_pages(df: DataFrame, path: str) -> None:
    """A table as pages: each row of the files holds the pages of every column for one batch of rows.

    Nothing is shuffled, and a task has one batch at a time.
    """
    kinds = _kinds(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(encode(c.to_pylist(), kind)) for c, kind in zip(b.columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([own], pa.list_(pa.list_(pa.binary())))], ["rows", "pages"])

    df.mapInArrow(run, PAGES).write.parquet(path)


def read_pages(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``write_pages`` wrote; a column whose pages do not hold all its rows fails."""
    kinds, arrow = _kinds(schema), to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, columns in zip(b["rows"].to_pylist(), b["pages"], strict=True):
                own = [decode(pages.as_py(), kind) for pages, kind in zip(columns, kinds, strict=True)]
                if any(len(c) != rows for c in own):
                    raise ValueError(f"columns of {[len(c) for c in own]} rows where {rows} were written")
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own, arrow, strict=True)], schema=arrow)

    return spark.read.schema(PAGES).parquet(path).mapInArrow(run, schema)
