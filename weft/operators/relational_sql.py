"""Relational queries: the oracle SQL, and how each is run here."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "scan_project": """SELECT n_name, n_nationkey FROM nation""",
    "filter_eq_string": """SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'""",
    "filter_neq_string": """SELECT p_partkey, p_type FROM part WHERE p_type != 'PROMO'""",
    "filter_lt_string": """SELECT p_partkey, p_brand FROM part WHERE p_brand < 'Brand#2'""",
    "filter_gt_int": """SELECT p_partkey, p_size FROM part WHERE p_size > 25""",
    "filter_geq_lt_int": """SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20""",
    "filter_leq_int64": """SELECT o_orderkey FROM orders WHERE o_custkey <= 10""",
    "filter_fp64": """SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0.05 AND l_quantity <= 5""",
    "filter_between": """SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15""",
    "filter_between_string": """SELECT p_partkey, p_type FROM part WHERE p_type BETWEEN 'A' AND 'M'""",
    "filter_in_string": """SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL', 'LARGE')""",
    "filter_in_int": """SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 42)""",
    "filter_like": """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'""",
    "filter_like_underscore": """SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_'""",
    "filter_not_like": """SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%widget%'""",
    "filter_is_null": """SELECT p_partkey FROM part WHERE NULLIF(p_type, 'PROMO') IS NULL""",
    "filter_is_not_null": """SELECT p_partkey FROM part WHERE NULLIF(p_type, 'PROMO') IS NOT NULL""",
    "filter_or": """SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name LIKE 'blue%'""",
    "filter_nested_and_or": """SELECT p_partkey, p_type, p_size FROM part WHERE p_type = 'PROMO' OR (p_type = 'SMALL' AND p_name LIKE 'r%')""",
    "filter_not_sql3vl": """SELECT p_partkey FROM part WHERE NOT (NULLIF(p_type, 'PROMO') = 'SMALL')""",
    "filter_not_2vl": """SELECT p_partkey FROM part WHERE NOT COALESCE(NULLIF(p_type, 'PROMO') = 'SMALL', FALSE)""",
    "join_two_way": """SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey""",
    "join_empty_side": """SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ATLANTIS'""",
    "join_no_match": """SELECT n.n_name, p.p_name FROM nation n, part p WHERE n.n_nationkey = p.p_partkey AND p.p_partkey > 1000""",
    "join_duplicate_keys": """SELECT c.c_custkey, s.s_suppkey FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey""",
    "join_null_keys": """SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a, nation b WHERE NULLIF(a.n_regionkey, 1) = NULLIF(b.n_regionkey, 1)""",
    "join_zero_key": """SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_custkey <= 1""",
    "join_payload_null": """SELECT n.n_nationkey, NULLIF(r.r_name, 'ASIA') AS r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey""",
    "join_output_reorder": """SELECT r.r_name, n.n_nationkey, n.n_name, r.r_regionkey FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey""",
    "join_self_alias": """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, s.s_suppkey, c.c_custkey FROM nation n1, nation n2, supplier s, customer c, orders o, lineitem l WHERE s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7'""",
    "join_transitive_closure": """SELECT o.o_orderkey, c.c_name, l.l_linenumber, p.p_name FROM orders o, customer c, lineitem l, part p WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey = c.c_custkey AND l.l_partkey = p.p_partkey AND l.l_orderkey = o.o_orderkey AND p.p_size < 5""",
    "join_key_class": """SELECT d.doc_id, l.quality, v.label FROM documents d, labels l, embeddings v WHERE d.doc_id = l.doc_id AND l.doc_id = v.vec_id AND d.doc_id = v.vec_id AND l.quality = 1""",
    "join_mixed_int_width": """SELECT n.n_name, c.c_custkey FROM nation n, customer c WHERE n.n_nationkey = c.c_custkey""",
    "join_snowflake": """SELECT r.r_name, n.n_name, c.c_name, o.o_orderkey FROM region r, nation n, customer c, orders o WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND r.r_name = 'EUROPE' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "join_varchar_key": """SELECT a.p_partkey AS a_part, b.p_partkey AS b_part FROM part a, part b WHERE a.p_name = b.p_name AND a.p_size = 1 AND b.p_size = 2""",
    "min_single": """SELECT MIN(p.p_name) AS min_name FROM part p, lineitem l WHERE p.p_partkey = l.l_partkey AND l.l_returnflag = 'R'""",
    "min_multi_mixed_types": """SELECT MIN(n.n_name) AS nation, MIN(c.c_custkey) AS cust, MIN(o.o_orderkey) AS ord FROM nation n, customer c, orders o WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND c.c_mktsegment LIKE '%MACH%' AND o.o_orderstatus != 'P'""",
    "min_empty_input": """SELECT MIN(n.n_name) AS nation FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ATLANTIS'""",
    "flagship_8way_min": """SELECT MIN(cn.n_name) AS cust_nation, MIN(s.s_name) AS supplier_name, MIN(p.p_name) AS part_name FROM region r, nation cn, nation sn, customer c, orders o, lineitem l, part p, supplier s WHERE r.r_regionkey = cn.n_regionkey AND cn.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = sn.n_nationkey AND r.r_name IN ('ASIA', 'EUROPE') AND p.p_type = 'PROMO' AND p.p_name LIKE '%widget%' AND o.o_orderpriority != '5-LOW' AND sn.n_name < 'NATION_5'""",
    "join_fp64_key": """SELECT a.l_orderkey AS a_order, a.l_linenumber AS a_line, b.l_orderkey AS b_order, b.l_linenumber AS b_line FROM lineitem a, lineitem b WHERE a.l_extendedprice = b.l_extendedprice AND a.l_returnflag = 'R' AND b.l_returnflag = 'A'""",
    "join_skewed_key": """SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l, orders o WHERE CASE WHEN l.l_orderkey % 3 = 0 THEN 1 ELSE l.l_orderkey END = o.o_orderkey""",
    "join_bushy_explain": """SELECT MIN(n1.n_name) AS supp_nation, MIN(n2.n_name) AS cust_nation, MIN(o.o_orderkey) AS first_order FROM nation n1, nation n2, region r, supplier s, customer c, orders o, lineitem l WHERE n1.n_regionkey = r.r_regionkey AND n2.n_regionkey = r.r_regionkey AND s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND r.r_name = 'ASIA' AND o.o_orderstatus != 'P'""",
    "min_raw": """SELECT n.n_name AS nation, c.c_custkey AS cust, o.o_orderkey AS ord FROM nation n, customer c, orders o WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND c.c_mktsegment LIKE '%MACH%' AND o.o_orderstatus != 'P'""",
}
