"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of text, doc_id), so that equal texts are neighbours. A
size-weighted sample of keys gives quantile boundaries; the ranges between them are
measured, and ranges that hold too much are sampled again and subdivided, until each is
small or a single key. Running sums inside the ranges then place every record: its shard is
where the middle of its bytes falls, so that shards differ from their share by no more
than a record, and its slot counts the records of its shard before it.

Nulls: a null text has size 8 and the checksum of the empty text; a null doc_id comes first
among equal hashes. Rows that are wholly equal take neighbouring slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.shared import cut, interval

#: Ranges are the unit of parallel work: text bytes of one, and how many there may be; keys sampled for each.
RANGE_BYTES, MIN_RANGES, MAX_RANGES, DRAWS = 4 << 20, 192, 4096, 12
#: A range is overfull beyond this many times its share; rounds of subdivision.
OVERFULL, ROUNDS = 2.5, 4


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h) of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
    )


def _range(splitters: list[tuple[int, int]]) -> Column:
    if not splitters:
        return F.lit(0)
    hs, ids = (F.lit(np.array([s[c] for s in splitters], dtype=np.int64)) for c in (0, 1))
    table = F.arrays_zip(hs, ids).cast("array<struct<h:bigint,doc_id:bigint>>")
    return interval(F.struct("h", "doc_id"), splitters, table)


def _sample(rows: DataFrame, rate: Column, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with probability size * rate, and the weight that each stands for; a bounded number."""
    u = (F.xxhash64("h", "doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    p = F.col("size") * rate
    drawn = rows.where(F.col("doc_id").isNotNull() & (u < p)).select("h", "doc_id", F.greatest(F.lit(1.0), p).alias("w"))
    return sorted((r.h, r.doc_id, r.w) for r in drawn.collect())


def _quantiles(keys: list[tuple[int, int, float]], n: int) -> set[tuple[int, int]]:
    """The keys at which the sample's weight passes each n-th of its whole."""
    out, at, step = set(), 0.0, sum(w for _, _, w in keys) / n
    for h, d, w in keys:
        if int((at + w) / step) > int(at / step):
            out.add((h, d))
        at += w
    return out


def splitters(rows: DataFrame, total: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Boundaries, and (bytes, records) of every range between them that holds any."""
    n = min(MAX_RANGES, max(MIN_RANGES, total // RANGE_BYTES))
    found = _quantiles(_sample(rows, F.lit(n * DRAWS / total), 0), n)
    for round in range(1, ROUNDS + 1):
        bounds = sorted(found)
        sums = {r.range: (r.bytes, r.n, r.one) for r in rows.groupBy(_range(bounds).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), (F.min(F.struct("h", "doc_id")) == F.max(F.struct("h", "doc_id"))).alias("one")).collect()}
        over = {r: b for r, (b, _, one) in sums.items() if b > OVERFULL * total / n and not one}
        if not over or round == ROUNDS:
            break
        ids, rates = (F.lit(np.array(x)) for x in (sorted(over), [DRAWS * max(2, over[r] * n // total) / over[r] for r in sorted(over)]))
        inside = rows.withColumn("range", _range(bounds)).withColumn("nth", F.array_position(ids, F.col("range").cast("long")).cast("int")).where("nth > 0")
        before = len(found)
        for h, d, _ in _sample(inside, F.get(rates, F.col("nth") - 1), round):
            found.add((h, d))
        if len(found) == before:
            break
    return bounds, {r: (b, c) for r, (b, c, _) in sums.items()}


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes).

    Texts are read once and never shuffled. To the driver come the sample (DRAWS keys for
    each of at most MAX_RANGES ranges) and the sums of the ranges.
    """
    rows = cut(records(docs), "records")
    total = int(rows.agg(F.sum("size")).collect()[0][0] or 0)
    if not total:
        bounds, sums = [], {0: (0, 0)}
    else:
        bounds, sums = splitters(rows, total)
    base_bytes, base_rows, b, n = [], [], 0, 0
    for r in range(len(bounds) + 1):
        base_bytes.append(b)
        base_rows.append(n)
        own = sums.get(r, (0, 0))
        b, n = b + own[0], n + own[1]
    at = lambda xs: F.get(F.lit(np.array(xs, dtype=np.int64)), F.col("range"))
    order = W.partitionBy("range").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("range", _range(bounds)).select(
        "doc_id", "size", "text_crc32", (at(base_bytes) + F.sum("size").over(order) - F.col("size")).alias("begin"), (at(base_rows) + F.count(F.lit(1)).over(order) - 1).alias("rank")
    )
    middle = (2 * F.col("begin") + F.col("size")) * F.lit(shards)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * max(1, total)))).cast("int"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The documents in folders shard=0.. of a table, each folder's files in order of slot.

    A column named shard or slot gives way to the record's; others may have any names.
    """
    own = [F.col("row").getField(f.name).alias(f.name) for f in docs.schema.fields if f.name.lower() not in ("shard", "slot")]
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    placed = assign(docs, shards).select(F.col("doc_id").alias("id"), "text_crc32", "shard", "slot").dropDuplicates(["id", "text_crc32"])
    out = keyed.join(placed, keyed.i.eqNullSafe(placed.id) & (keyed.c == placed.text_crc32)).select(*own, "shard", "slot")
    out.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
