"""Connected components by alternating stars.

Large-star links the larger neighbours of a node to the smallest of its neighbourhood,
small-star the smaller ones; both keep the components, and together they end in one star
around each component's smallest node. Edges live in tables of the shared folder between
the steps, so a lost executor costs a step at most, and joins on a hot node read plain
shuffles that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import Tables


def _large(edges: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    out = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least, out.where("u != v").distinct()


def _small(edges: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least, others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Links may repeat and point either way; self-links and links with a null say nothing. The
    table that the result reads is one of ``tables``, whose owner drops it.
    """
    tables = tables or Tables()
    cut = tables.cut
    a, b = F.col(links.columns[0]).cast("long"), F.col(links.columns[1]).cast("long")
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v").cast("long"))).collect()[0]
        if seen == state or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
        seen = state
        for star in (_large, _small):
            least, new = star(edges, cut)
            new = cut(new, "edges")
            tables.drop(least, edges)
            edges = new
