"""Single-table predicate trees, lowered to Catalyst expressions.

Literals are checked against the column's type when the tree is lowered, so that a
mismatch fails before a job starts. ``null_logic`` chooses what NOT does to an unknown
comparison: ``"sql"`` keeps SQL's three values, ``"two_valued"`` lets a comparison with
NULL be plainly false, so that its negation is true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.types import DataType

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


class Predicate:
    """A node of the tree; ``&``, ``|`` and ``~`` combine nodes."""

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def columns(self) -> set[str]:
        raise NotImplementedError

    def lower(self, schema: dict[str, DataType], resolve: Callable[[str], Column] = F.col, null_logic: str = "sql") -> Column:
        raise NotImplementedError


def _known(name: str, schema: dict[str, DataType]) -> DataType:
    if name not in schema:
        raise KeyError(f"unknown column {name!r}; there are {sorted(schema)}")
    return schema[name]


def _checked(name: str, kind: DataType, value: object) -> Column:
    if not kind.accepts(value):
        raise TypeError(f"literal {value!r} does not fit column {name!r} of type {kind.value}")
    return F.lit(value).cast(kind.spark)


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str
    value: int | float | str

    def columns(self) -> set[str]:
        return {self.column}

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        op = "!=" if self.op == "<>" else self.op
        out = COMPARISONS[op](resolve(self.column), _checked(self.column, _known(self.column, schema), self.value))
        return out if null_logic == "sql" else F.coalesce(out, F.lit(False))

    def __str__(self) -> str:
        return f"{self.column} {self.op} {self.value!r}"


@dataclass(frozen=True)
class Like(Predicate):
    """``%`` and ``_`` are wild, there is no escape character, strings only."""

    column: str
    pattern: str
    negated: bool = False

    def columns(self) -> set[str]:
        return {self.column}

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        if _known(self.column, schema) is not DataType.VARCHAR:
            raise TypeError(f"LIKE needs a string column, {self.column!r} is not")
        out = resolve(self.column).like(self.pattern.replace("\\", "\\\\"))
        out = ~out if self.negated else out
        # a NULL cell passes neither LIKE nor NOT LIKE, whichever logic holds around it
        return out if null_logic == "sql" else F.coalesce(out, F.lit(False))

    def __str__(self) -> str:
        return f"{self.column} {'NOT ' * self.negated}LIKE {self.pattern!r}"


@dataclass(frozen=True)
class Between(Predicate):
    column: str
    low: int | float | str
    high: int | float | str

    def columns(self) -> set[str]:
        return {self.column}

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        kind, c = _known(self.column, schema), resolve(self.column)
        out = c.between(_checked(self.column, kind, self.low), _checked(self.column, kind, self.high))
        return out if null_logic == "sql" else F.coalesce(out, F.lit(False))

    def __str__(self) -> str:
        return f"{self.column} BETWEEN {self.low!r} AND {self.high!r}"


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple[int | float | str, ...]

    def columns(self) -> set[str]:
        return {self.column}

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        kind = _known(self.column, schema)
        out = resolve(self.column).isin(*[_checked(self.column, kind, v) for v in self.values])
        return out if null_logic == "sql" else F.coalesce(out, F.lit(False))

    def __str__(self) -> str:
        return f"{self.column} IN {self.values!r}"


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str
    negated: bool = False

    def columns(self) -> set[str]:
        return {self.column}

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        _known(self.column, schema)
        return resolve(self.column).isNotNull() if self.negated else resolve(self.column).isNull()

    def __str__(self) -> str:
        return f"{self.column} IS {'NOT ' * self.negated}NULL"


class _Chain(Predicate):
    word = ""

    def __init__(self, *parts: Predicate):
        if not parts:
            raise ValueError(f"{type(self).__name__} needs a part")
        self.parts = parts

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def __str__(self) -> str:
        return "(" + f" {self.word} ".join(map(str, self.parts)) + ")"


class And(_Chain):
    word = "AND"

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        return reduce(lambda a, b: a & b, (p.lower(schema, resolve, null_logic) for p in self.parts))


class Or(_Chain):
    word = "OR"

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        return reduce(lambda a, b: a | b, (p.lower(schema, resolve, null_logic) for p in self.parts))


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def columns(self) -> set[str]:
        return self.part.columns()

    def lower(self, schema, resolve=F.col, null_logic="sql"):
        return ~self.part.lower(schema, resolve, null_logic)

    def __str__(self) -> str:
        return f"NOT {self.part}"


def where(df: DataFrame, predicate: Predicate | None, null_logic: str = "sql") -> DataFrame:
    """The rows of ``df`` for which the predicate is true; only columns it names need an engine type."""
    if predicate is None:
        return df
    named = predicate.columns()
    schema = {f.name: DataType.of(f.dataType) for f in df.schema.fields if f.name in named}
    return df.where(predicate.lower(schema, lambda c: df[c], null_logic))


def all_of(parts: Sequence[Predicate]) -> Predicate | None:
    return parts[0] if len(parts) == 1 else And(*parts) if parts else None
