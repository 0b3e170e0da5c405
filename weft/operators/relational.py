"""The relational queries, by name: each callable takes (spark, folder) and returns a DataFrame.

Filters go through the predicate trees, joins through the SQL front-end with greedy order,
the plan API, an EXPLAIN plan or Catalyst with a join hint, so that every path is exercised.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.predicates import Between, Compare, In, IsNull, Like, Not, Predicate, where
from weft.operators.relational_sql import ORACLE
from weft.plans.explain_json import run_plan
from weft.plans.joingraph import JoinGraph
from weft.plans.plan import Plan, execute
from weft.plans.sql import run_sql
from weft.sources.tables import ParquetTables
from weft.types import DataType

Run = Callable[[SparkSession, str], DataFrame]

FILTERS: dict[str, tuple[str, Predicate, list[str]]] = {
    "filter_eq_string": ("part", Compare("p_type", "=", "PROMO"), ["p_partkey", "p_name"]),
    "filter_neq_string": ("part", Compare("p_type", "!=", "PROMO"), ["p_partkey", "p_type"]),
    "filter_lt_string": ("part", Compare("p_brand", "<", "Brand#2"), ["p_partkey", "p_brand"]),
    "filter_gt_int": ("part", Compare("p_size", ">", 25), ["p_partkey", "p_size"]),
    "filter_geq_lt_int": ("part", Compare("p_size", ">=", 10) & Compare("p_size", "<", 20), ["p_partkey", "p_size"]),
    "filter_leq_int64": ("orders", Compare("o_custkey", "<=", 10), ["o_orderkey"]),
    "filter_fp64": ("lineitem", Compare("l_discount", ">", 0.05) & Compare("l_quantity", "<=", 5), ["l_orderkey", "l_linenumber", "l_discount"]),
    "filter_between": ("part", Between("p_size", 5, 15), ["p_partkey", "p_size"]),
    "filter_between_string": ("part", Between("p_type", "A", "M"), ["p_partkey", "p_type"]),
    "filter_in_string": ("part", In("p_type", ("PROMO", "SMALL", "LARGE")), ["p_partkey", "p_type"]),
    "filter_in_int": ("part", In("p_size", (1, 7, 42)), ["p_partkey", "p_size"]),
    "filter_like": ("part", Like("p_name", "%widget%"), ["p_partkey", "p_name"]),
    "filter_like_underscore": ("part", Like("p_brand", "Brand#_"), ["p_partkey", "p_brand"]),
    "filter_not_like": ("part", Like("p_name", "%widget%", negated=True), ["p_partkey", "p_name"]),
    "filter_or": ("part", Like("p_name", "red%") | Like("p_name", "blue%"), ["p_partkey"]),
    "filter_nested_and_or": ("part", Compare("p_type", "=", "PROMO") | (Compare("p_type", "=", "SMALL") & Like("p_name", "r%")), ["p_partkey", "p_type", "p_size"]),
}

#: On part with p_type NULL where it was PROMO.
NULL_FILTERS: dict[str, tuple[Predicate, str]] = {
    "filter_is_null": (IsNull("p_type"), "sql"),
    "filter_is_not_null": (IsNull("p_type", negated=True), "sql"),
    "filter_not_sql3vl": (Not(Compare("p_type", "=", "SMALL")), "sql"),
    "filter_not_2vl": (Not(Compare("p_type", "=", "SMALL")), "two_valued"),
}

GREEDY = [
    "join_empty_side", "join_no_match", "join_duplicate_keys", "join_zero_key", "join_output_reorder", "join_self_alias", "join_transitive_closure",
    "join_key_class", "join_mixed_int_width", "join_snowflake", "join_varchar_key", "min_single", "min_multi_mixed_types", "min_empty_input", "join_fp64_key",
]


def _filter(table: str, predicate: Predicate, columns: list[str], spark: SparkSession, folder: str) -> DataFrame:
    return where(ParquetTables(spark, folder)[table], predicate).select(*columns)


def _null_filter(predicate: Predicate, logic: str, spark: SparkSession, folder: str) -> DataFrame:
    part = ParquetTables(spark, folder)["part"].select("p_partkey", F.expr("NULLIF(p_type, 'PROMO')").alias("p_type"))
    return where(part, predicate, logic).select("p_partkey")


class _Named(ParquetTables):
    """Every name is known before it is opened, for the SQL front-end's binder."""

    def items(self):
        return [(t, self[t]) for t in self.names]


def _tables(spark: SparkSession, folder: str, sql: str) -> _Named:
    import re

    words = set(re.findall(r"\w+", sql))
    return _Named(spark, folder, tuple(t for t in ParquetTables(spark, folder).names if t in words))


def _sql(name: str, order: str, spark: SparkSession, folder: str, raw: bool = False) -> DataFrame:
    sql = ORACLE[name]
    return run_sql(spark, sql, _tables(spark, folder, sql), raw=raw, order=order)


def _scan_project(spark: SparkSession, folder: str) -> DataFrame:
    plan = Plan()
    plan.root = plan.add_scan(plan.add_input(ParquetTables(spark, folder)["nation"]), [(1, DataType.VARCHAR), (0, DataType.INT32)])
    return execute(spark, plan, ["n_name", "n_nationkey"])


def _two_way_hint(hint: str, spark: SparkSession, folder: str) -> DataFrame:
    t = ParquetTables(spark, folder)
    return t["nation"].join(t["region"].hint(hint), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


def _two_way_plan(build_left: bool, spark: SparkSession, folder: str) -> DataFrame:
    t, plan = ParquetTables(spark, folder), Plan()
    text, number = DataType.VARCHAR, DataType.INT32
    n = plan.add_scan(plan.add_input(t["nation"]), [(1, text), (2, number)])
    r = plan.add_scan(plan.add_input(t["region"]), [(0, number), (1, text)])
    plan.root = plan.add_join(n, r, 1, 0, [(0, text), (3, text)], build_left)
    return execute(spark, plan, ["n_name", "r_name"], honor_build_side=True)


def _two_way_explain(spark: SparkSession, folder: str) -> DataFrame:
    scan = lambda alias: {"Node Type": "Seq Scan", "Alias": alias}
    tree = {"Plan": {"Node Type": "Gather", "Plans": [{"Node Type": "Hash Join", "Plans": [scan("n"), {"Node Type": "Hash", "Plans": [scan("r")]}]}]}}
    sql = ORACLE["join_two_way"]
    return run_plan(sql, tree, _tables(spark, folder, sql))


def _bushy_explain(spark: SparkSession, folder: str) -> DataFrame:
    """A plan of two branches, with one relation in both, under Gather and Aggregate."""
    scan = lambda alias, kind="Seq Scan": {"Node Type": kind, "Alias": alias}
    join = lambda left, right: {"Node Type": "Hash Join", "Plans": [left, {"Node Type": "Hash", "Plans": [right]}]}
    suppliers = join(scan("l"), join(scan("s"), join(scan("n1"), scan("r"))))
    customers = join(scan("o", "Index Only Scan"), join(scan("c"), scan("n2")))
    tree = {"Plan": {"Node Type": "Aggregate", "Plans": [{"Node Type": "Gather", "Plans": [{"Node Type": "Aggregate", "Plans": [join(suppliers, customers)]}]}]}}
    sql = ORACLE["join_bushy_explain"]
    return run_plan(sql, tree, _tables(spark, folder, sql))


def _skewed_key(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the rows have one key."""
    t = ParquetTables(spark, folder)
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey")).alias("k"))
    out = JoinGraph({"l": lines, "o": t["orders"]}, equal=[(("l", "k"), ("o", "o_orderkey"))]).plan()
    return out.select(F.col("l__l_orderkey").alias("l_orderkey"), F.col("l__l_linenumber").alias("l_linenumber"), F.col("o__o_custkey").alias("o_custkey"))


def _null_keys(spark: SparkSession, folder: str) -> DataFrame:
    nation = ParquetTables(spark, folder)["nation"].select("n_nationkey", F.expr("NULLIF(n_regionkey, 1)").alias("k"))
    out = JoinGraph({"a": nation, "b": nation}, equal=[(("a", "k"), ("b", "k"))]).plan()
    return out.select(F.col("a__n_nationkey").alias("a_key"), F.col("b__n_nationkey").alias("b_key"))


def _payload_null(spark: SparkSession, folder: str) -> DataFrame:
    t = ParquetTables(spark, folder)
    region = t["region"].select("r_regionkey", F.expr("NULLIF(r_name, 'ASIA')").alias("r_name"))
    out = JoinGraph({"n": t["nation"], "r": region}, equal=[(("n", "n_regionkey"), ("r", "r_regionkey"))]).plan()
    return out.select(F.col("n__n_nationkey").alias("n_nationkey"), F.col("r__r_name").alias("r_name"))


def queries() -> dict[str, Run]:
    out: dict[str, Run] = {"scan_project": _scan_project}
    out |= {name: partial(_filter, *spec) for name, spec in FILTERS.items()}
    out |= {name: partial(_null_filter, *spec) for name, spec in NULL_FILTERS.items()}
    out |= {name: partial(_sql, name, "greedy") for name in GREEDY}
    out |= {"join_null_keys": _null_keys, "join_payload_null": _payload_null, "join_skewed_key": _skewed_key, "join_bushy_explain": _bushy_explain}
    out |= {"min_raw": lambda spark, folder: _sql("min_multi_mixed_types", "greedy", spark, folder, raw=True)}
    out |= {"join_two_way": partial(_sql, "join_two_way", "catalyst"), "join_two_way_explain": _two_way_explain}
    out |= {f"join_two_way_{hint}": partial(_two_way_hint, hint) for hint in ("broadcast", "shuffle_hash", "merge")}
    out |= {f"join_two_way_build_{side}": partial(_two_way_plan, side == "left") for side in ("left", "right")}
    out |= {"join_snowflake_raw": lambda spark, folder: _sql("join_snowflake", "greedy", spark, folder, raw=True)}
    out |= {"join_transitive_exact_order": partial(_sql, "join_transitive_closure", "greedy_exact")}
    out |= {"flagship_8way_min": flagship, "flagship_8way_catalyst": partial(_sql, "flagship_8way_min", "catalyst")}
    return out


def oracle_sql() -> dict[str, str]:
    same = {"join_snowflake_raw": "join_snowflake", "join_transitive_exact_order": "join_transitive_closure", "flagship_8way_catalyst": "flagship_8way_min"}
    same |= {name: "join_two_way" for name in queries() if name.startswith("join_two_way_")}
    return ORACLE | {name: ORACLE[of] for name, of in same.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Eight relations, one of them twice, filtered on five tables, three minima."""
    return _sql("flagship_8way_min", "greedy", spark, folder)
