"""Join graphs: equality classes, join order, and lowering to chained joins.

Columns made equal form classes (union-find). Any two relations that share a class can be
joined on it, whichever pair the query wrote, so every connected order finds a condition;
all classes that two sides share are applied, never just one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.predicates import Predicate, where

Key = tuple[str, str]


class DisconnectedJoin(ValueError):
    """Two groups of relations without an equality between them."""


@dataclass
class JoinGraph:
    """relations: alias to DataFrame; filters: alias to predicate; equal: pairs of (alias, column)."""

    relations: dict[str, DataFrame]
    filters: dict[str, Predicate] = field(default_factory=dict)
    equal: list[tuple[Key, Key]] = field(default_factory=list)
    null_logic: str = "sql"

    def classes(self) -> list[list[Key]]:
        parent: dict[Key, Key] = {}

        def find(x: Key) -> Key:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in self.equal:
            for alias, column in (a, b):
                if alias not in self.relations or column not in self.relations[alias].columns:
                    raise KeyError(f"unknown column {alias}.{column}")
            parent[find(a)] = find(b)
        out: dict[Key, list[Key]] = {}
        for x in parent:
            out.setdefault(find(x), []).append(x)
        return list(out.values())

    def leaves(self, keep: dict[str, set[str]] | None = None) -> dict[str, DataFrame]:
        """Filtered relations with columns ``alias__column``; equalities inside one relation are filters."""
        out = {}
        for alias, df in self.relations.items():
            df = where(df, self.filters.get(alias), self.null_logic)
            for group in self.classes():
                own = [c for a, c in group if a == alias]
                for c in own[1:]:
                    df = df.where(F.col(own[0]) == F.col(c))
            names = [c for c in df.columns if keep is None or c in keep[alias]]
            out[alias] = df.select(*[F.col(c).alias(f"{alias}__{c}") for c in names])
        return out

    def order(self, sizes: dict[str, float]) -> list[tuple[frozenset[str], frozenset[str]]]:
        """Greedy: always join the connected pair of groups with the smallest product of sizes.

        A joined group counts as its larger part, which is what a key/foreign-key join yields.
        """
        groups: dict[frozenset[str], float] = {frozenset([a]): max(1.0, sizes[a]) for a in self.relations}
        joined = [{a for a, _ in group} for group in self.classes()]
        steps = []
        while len(groups) > 1:
            pairs = [
                (groups[x] * groups[y], sorted(x), sorted(y), x, y)
                for x in groups
                for y in groups
                if sorted(x) < sorted(y) and any(c & x and c & y for c in joined)
            ]
            if not pairs:
                raise DisconnectedJoin(f"no equality joins {[sorted(g) for g in groups]}")
            _, _, _, x, y = min(pairs, key=lambda p: p[:3])
            steps.append((x, y))
            groups[x | y] = max(groups.pop(x), groups.pop(y))
        return steps

    def join(self, steps: Iterable[tuple[frozenset[str], frozenset[str]]], keep: dict[str, set[str]] | None = None) -> DataFrame:
        classes = self.classes()
        if keep is not None:
            keep = {a: set(keep.get(a, ())) | {c for g in classes for b, c in g if b == a} for a in self.relations}
        parts = {frozenset([a]): df for a, df in self.leaves(keep).items()}
        for x, y in steps:
            conditions: list[Column] = []
            for group in classes:
                a = next((k for k in group if k[0] in x), None)
                b = next((k for k in group if k[0] in y), None)
                if a and b:
                    conditions.append(F.col("__".join(a)) == F.col("__".join(b)))
            if not conditions:
                raise DisconnectedJoin(f"no equality joins {sorted(x)} and {sorted(y)}")
            parts[x | y] = parts.pop(x).join(parts.pop(y), conditions, "inner")
        (out,) = parts.values()
        return out

    def sizes(self, exact: bool = False) -> dict[str, float]:
        """Rows of the filtered relations by a count each, or Catalyst's estimate in bytes."""
        if exact:
            return {a: float(df.count()) for a, df in self.leaves().items()}
        estimate: Callable[[DataFrame], float] = lambda df: float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return {a: estimate(df) for a, df in self.leaves().items()}

    def plan(self, keep: dict[str, set[str]] | None = None, exact: bool = False, steps: Sequence[tuple[frozenset[str], frozenset[str]]] | None = None) -> DataFrame:
        """The joined DataFrame; ``steps`` overrides the greedy order. Columns are ``alias__column``."""
        return self.join(self.order(self.sizes(exact)) if steps is None else steps, keep)
