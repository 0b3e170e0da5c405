"""Logical plans: explicit scan/join plans, join graphs, SQL and EXPLAIN front-ends."""
