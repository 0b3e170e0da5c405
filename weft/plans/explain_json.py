"""Join order taken from PostgreSQL's EXPLAIN (FORMAT JSON).

Only the shape of the tree is used: hash joins and scans by alias. Aggregate, Gather and
Hash nodes are passed through; any other node is refused. Conditions come from the query.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

from weft.plans.sql import parse

THROUGH = {"Aggregate", "Gather", "Hash"}
SCANS = {"Seq Scan", "Index Only Scan"}


class UnsupportedPlan(ValueError):
    """A node other than those above."""


def steps(node: dict) -> list[tuple[frozenset[str], frozenset[str]]]:
    """The joins of a plan tree, children first."""
    out: list[tuple[frozenset[str], frozenset[str]]] = []

    def walk(n: dict) -> frozenset[str]:
        kind, children = n.get("Node Type"), n.get("Plans", [])
        if kind in SCANS:
            return frozenset([n.get("Alias") or n["Relation Name"]])
        if kind in THROUGH and len(children) == 1:
            return walk(children[0])
        if kind == "Hash Join" and len(children) == 2:
            left, right = walk(children[0]), walk(children[1])
            out.append((left, right))
            return left | right
        raise UnsupportedPlan(f"{kind} with {len(children)} children")

    walk(node.get("Plan", node))
    return out


def run_plan(sql: str, plan: str | dict, tables: Mapping[str, DataFrame], raw: bool = False) -> DataFrame:
    """The query's result, joined in the plan's order."""
    tree = json.loads(plan) if isinstance(plan, str) else plan
    tree = tree[0] if isinstance(tree, list) else tree
    query = parse(sql, {t: df.columns for t, df in tables.items()})
    order = steps(tree)
    named = set().union(*(x | y for x, y in order)) if order else set()
    if named != set(query.tables):
        raise UnsupportedPlan(f"the plan scans {sorted(named)}, the query {sorted(query.tables)}")
    return query.run(tables, raw, steps=order)


def run_workload(plans: str, sql_texts: Mapping[str, str], tables: Mapping[str, DataFrame], raw: bool = False) -> dict[str, DataFrame]:
    """All queries of a plans file: {"names": [...], "plans": [{"Plan": ...}]}."""
    spec = json.loads(plans)
    return {n: run_plan(sql_texts[n], p, tables, raw) for n, p in zip(spec["names"], spec["plans"], strict=True)}
