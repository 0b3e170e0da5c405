"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With target weight w, its j-th block (from 1) is released
at slot floor((j - 1) / w) and due by slot ceil(j / w); each slot goes to the released block
that is due first. Weights are fractions n / period, so one period of the schedule, worked
out on the driver, repeats for ever, and a block's slot follows from its number alone: at
any slot each source that lasts has had its share to within less than one block.

A source that has run out leaves its slots empty; every document is placed exactly once.

Nulls: a null source is the source named ``''``; a null doc_id is ordered first in its
source. Rows that are wholly equal take neighbouring places. Documents may have columns of
any names: they travel as one struct. Only ``mix`` gives its five columns beside them, in
place of any that have those names.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents of a block, and slots of a period at least; more sources make it longer.
BLOCK, PERIOD = 16, 1024


def quotas(weights: Mapping[str, int], period: int = PERIOD) -> dict[str, int]:
    """Blocks of each source in a period: its rounded share, one at least. The period is their sum."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    return {s: max(1, (2 * period * w + total) // (2 * total)) for s, w in weights.items()}


def schedule(blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period: (source, j from 0, release, deadline, slot), earliest deadline first."""
    period = sum(blocks.values())
    names = sorted(blocks)
    release = lambda s, j: j * period // blocks[s]
    deadline = lambda s, j: -(-(j + 1) * period // blocks[s])
    waiting = [(0, s, 0) for s in names]
    ready: list[tuple[int, str, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, j), s, j))
        due, s, j = heapq.heappop(ready)
        out.append((s, j, release(s, j), due, slot))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return out


def root_weights(docs: DataFrame) -> dict[str, int]:
    """Target weights in proportion to the square root of a source's documents, as whole numbers.

    One row per source comes to the driver, as it would with weights written by hand.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.floor(F.sqrt(F.count(F.lit(1))) * 1000).cast("long").alias("w"))
    return {r.source: r.w for r in counts.collect()}


PLACE = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The documents with mix_block, mix_release, mix_deadline, mix_slot and mix_place."""
    own = [F.col("row").getField(f.name).alias(f.name) for f in docs.schema.fields if f.name.lower() not in PLACE]
    return placed(docs, weights, block, period).select(*own, *PLACE)


def placed(docs: DataFrame, weights: Mapping[str, int] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(row, a struct of the document's columns; mix_block, mix_release, mix_deadline, mix_slot, mix_place).

    mix_place is unique and orders the mix. Inside a source the order is by the MD5 of the
    doc_id. A source's numbering is dealt out by the first digits of that digest, and a
    prefix sum over their counts joins the parts, so a hot source is no single task; rows
    without a doc_id are dealt out by their text's.
    Sources without a weight get one block a period.
    """
    have = {f.name for f in docs.schema.fields}
    if "source" not in have or "doc_id" not in have:
        raise ValueError("documents need doc_id and source")
    given = dict(weights if weights is not None else root_weights(docs))
    name = F.coalesce("source", F.lit(""))
    counts = docs.groupBy(name.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    n_rows = sum(r.n for r in counts)
    blocks = quotas({r.s: given.get(r.s, 0) for r in counts}, period) if n_rows and any(given.get(r.s) for r in counts) else {r.s: 1 for r in counts}
    length = sum(blocks.values())
    spark = docs.sparkSession
    digits = 1 if n_rows < 2_000 else 2 if n_rows < 200_000 else 3 if n_rows < 40_000_000 else 4

    # rows without a doc_id come first, by the digest of their text
    unnamed = F.concat(F.lit(" "), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))) if "text" in have else F.lit("")
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), unnamed)
    cell = F.substring(order, 1, F.when(F.col("doc_id").isNull(), digits + 1).otherwise(digits))
    own = docs.select(F.struct("*").alias("row"), name.alias("s"), order.alias("o"), cell.alias("c"))
    part = W.partitionBy("s", "c").orderBy("o", "row.doc_id", *(["row.text"] if "text" in have else []))
    own = own.withColumn("n", F.row_number().over(part).cast("long") - 1)
    sums = docs.select(name.alias("s"), cell.alias("c")).groupBy("s", "c").agg(F.count(F.lit(1)).alias("k"))
    before = sums.select("s", "c", (F.sum("k").over(W.partitionBy("s").orderBy("c").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")).alias("b"))
    own = own.join(before, ["s", "c"]).withColumn("n", F.col("n") + F.col("b"))
    per = spark.createDataFrame(sorted(blocks.items()), "s string, q long")
    own = own.join(F.broadcast(per), "s")  # a row per source
    own = own.withColumn("mix_block", F.expr(f"n div {block}")).withColumn("j", F.col("mix_block") % F.col("q")).withColumn("r", F.expr("mix_block div q") * F.lit(length))
    slots = spark.createDataFrame(schedule(blocks), "s string, j long, release long, due long, slot long")
    own = own.join(F.broadcast(slots), ["s", "j"])  # the rows of one period
    return own.select(
        "row", "mix_block", (F.col("r") + F.col("release")).alias("mix_release"), (F.col("r") + F.col("due")).alias("mix_deadline"), (F.col("r") + F.col("slot")).alias("mix_slot"),
        ((F.col("r") + F.col("slot")) * block + F.col("n") % block).alias("mix_place"),
    )


def in_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in the order of the mix: written out, part files by name and rows by place hold it."""
    by = [F.col("mix_place")]
    out = mixed.repartitionByRange(partitions, *by) if partitions else mixed.repartitionByRange(*by)
    return out.sortWithinPartitions(*by)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, text FROM documents),
w AS (SELECT source, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS w FROM d GROUP BY source),
q AS (SELECT source, greatest(1, (2 * p * w + t) // (2 * t)) AS n FROM w, (SELECT sum(w)::BIGINT AS t, greatest({PERIOD}, 4 * count(*)) AS p FROM w)),
k AS (SELECT list(n::BIGINT ORDER BY source) AS n, list(source ORDER BY source) AS names, sum(n)::BIGINT AS p, count(*)::BIGINT AS s FROM q),
e AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS done FROM k
  UNION ALL
  SELECT slot + 1, pick, done[pick], list_transform(done, lambda x, y: CASE WHEN y = pick THEN x + 1 ELSE x END)
  FROM (SELECT e.slot, e.done, 1 + list_min(list_transform(range(1, k.s + 1), lambda y: CASE
    WHEN e.done[y] < k.n[y] AND (e.done[y] * k.p) // k.n[y] <= e.slot + 1 THEN (((e.done[y] + 1) * k.p + k.n[y] - 1) // k.n[y]) * k.s + y - 1 ELSE 1000000000000 END)) % k.s AS pick
    FROM e, k WHERE e.slot + 1 < k.p)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id, text) - 1 AS x FROM d),
b AS (SELECT r.*, x // {BLOCK} AS mix_block, n FROM r JOIN q USING (source))
SELECT b.doc_id, b.source, mix_block, (mix_block // b.n) * k.p + (e.j * k.p) // b.n AS mix_release, (mix_block // b.n) * k.p + ((e.j + 1) * k.p + b.n - 1) // b.n AS mix_deadline,
  (mix_block // b.n) * k.p + e.slot AS mix_slot, ((mix_block // b.n) * k.p + e.slot) * {BLOCK} + x % {BLOCK} AS mix_place
FROM b, k, e WHERE k.names[e.i] = b.source AND e.j = mix_block % b.n
"""
