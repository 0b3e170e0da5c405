"""Positional scan/join plans and their lowering to a DataFrame.

A plan is a list of nodes; a join names its children by index. Columns are addressed by
position: output ``i`` of a join is left column ``i``, or right column ``i - n_left``.
Lowering renames every column by node, so self-joins and repeated outputs need no care,
and leaves order of work, algorithm and build side to Catalyst unless asked otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.types import DataType

Attr = tuple[int, DataType]


@dataclass(frozen=True)
class Scan:
    input: int
    output: tuple[Attr, ...]


@dataclass(frozen=True)
class Join:
    left: int
    right: int
    left_key: int
    right_key: int
    output: tuple[Attr, ...]
    build_left: bool = True


@dataclass
class Plan:
    """Nodes, their input tables and the root."""

    nodes: list[Scan | Join] = field(default_factory=list)
    inputs: list[DataFrame] = field(default_factory=list)
    root: int = 0

    def add_input(self, df: DataFrame) -> int:
        self.inputs.append(df)
        return len(self.inputs) - 1

    def add_scan(self, input: int, output: Sequence[Attr]) -> int:
        self.nodes.append(Scan(input, tuple(output)))
        return len(self.nodes) - 1

    def add_join(self, left: int, right: int, left_key: int, right_key: int, output: Sequence[Attr], build_left: bool = True) -> int:
        self.nodes.append(Join(left, right, left_key, right_key, tuple(output), build_left))
        return len(self.nodes) - 1

    def validate(self) -> None:
        """Indices, types and the single root; what is wrong raises ValueError or TypeError."""
        used: set[int] = set()
        for i, node in enumerate(self.nodes):
            if isinstance(node, Scan):
                if not 0 <= node.input < len(self.inputs):
                    raise ValueError(f"node {i}: no input {node.input}")
                have = [DataType.of(f.dataType) for f in self.inputs[node.input].schema.fields]
            else:
                for child in (node.left, node.right):
                    if not 0 <= child < len(self.nodes) or child in used:
                        raise ValueError(f"node {i}: child {child} is missing or has two parents")
                    used.add(child)
                left, right = ([kind for _, kind in self.nodes[c].output] for c in (node.left, node.right))
                if not (0 <= node.left_key < len(left) and 0 <= node.right_key < len(right)):
                    raise ValueError(f"node {i}: join key out of range")
                if left[node.left_key] is not right[node.right_key]:
                    raise TypeError(f"node {i}: joins {left[node.left_key].value} with {right[node.right_key].value}")
                have = left + right
            for at, kind in node.output:
                if not 0 <= at < len(have):
                    raise ValueError(f"node {i}: no column {at}")
                if have[at] is not kind:
                    raise TypeError(f"node {i}: column {at} is {have[at].value}, not {kind.value}")
        if not 0 <= self.root < len(self.nodes):
            raise ValueError(f"no root {self.root}")


def lower(plan: Plan, node: int, honor_build_side: bool = False, nan_matches: bool = False) -> DataFrame:
    """The DataFrame of one node, columns ``n<node>_<i>``."""
    this = plan.nodes[node]
    if isinstance(this, Scan):
        df = plan.inputs[this.input]
        plain = df.toDF(*[f"i{node}_{i}" for i in range(len(df.columns))])
        return plain.select(*[F.col(f"i{node}_{at}").alias(f"n{node}_{i}") for i, (at, _) in enumerate(this.output)])
    left, right = (lower(plan, c, honor_build_side, nan_matches) for c in (this.left, this.right))
    names = left.columns + right.columns
    a, b = F.col(left.columns[this.left_key]), F.col(right.columns[this.right_key])
    if plan.nodes[this.left].output[this.left_key][1] is DataType.FP64 and not nan_matches:
        left = left.where(~F.isnan(a))
    if honor_build_side:
        left, right = (left.hint("shuffle_hash"), right) if this.build_left else (left, right.hint("shuffle_hash"))
    out = left.join(right, a == b, "inner")
    return out.select(*[F.col(names[at]).alias(f"n{node}_{i}") for i, (at, _) in enumerate(this.output)])


def execute(spark: SparkSession, plan: Plan, names: Sequence[str] | None = None, honor_build_side: bool = False) -> DataFrame:
    """Run a plan: columns ``c0..cn`` or ``names``. NULL keys match nothing, zero keys match."""
    plan.validate()
    out = lower(plan, plan.root, honor_build_side)
    return out.toDF(*(names or [f"c{i}" for i in range(len(out.columns))]))
