"""Near-duplicate embeddings.

Random-hyperplane signs put every vector into a bucket of each of several tables. Inside a
bucket a matrix product in double precision finds the pairs at or above the threshold;
a pair is counted only in the first table where it meets, so no pair is ever written out:
a bucket yields a row per vector, its count and its smallest known relative. Overfull
buckets are cut into blocks, and pairs of blocks are the unit of work.

The tables' number follows from the wanted recall at the threshold, the signs of a code
from the number of vectors. Equal vectors are folded into one with a count beforehand.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
rows without a vec_id. Vectors of different lengths do not link. If a vec_id repeats, each
row is a vector of its own with its own links; a component is named by its smallest vec_id, so
two of them may go by one name. Only vec_id and embedding are looked at, whatever other
columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.shared import cut, drop, trimmed

THRESHOLD, RECALL = 0.9, 0.995
#: Vectors that a bucket should hold, and that a block holds at most.
BUCKET, BLOCK = 192, 1024
SEED = 20_240_601


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a code, tables) for n vectors."""
    bits = min(30, max(3, math.ceil(math.log2(max(1, n / BUCKET)))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _codes(bits: int, tables: int):
    planes: dict[int, np.ndarray] = {}

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            flat = b["v"].to_pylist()
            for dim in {len(v) for v in flat}:
                at = [k for k, v in enumerate(flat) if len(v) == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).standard_normal((dim, bits * tables))
                x = np.array([flat[k] for k in at], dtype=np.float64)
                codes = ((x @ planes[dim] >= 0).reshape(len(at), tables, bits) @ place).astype(np.int32)
                narrow = x.astype(np.float32)
                stored = narrow if np.array_equal(narrow, x) else x  # single precision where that loses nothing
                take = b.take(pa.array(at))
                columns = [take["node"], take["mult"], pa.array([dim] * len(at), pa.int32()), pa.array([r.tobytes() for r in stored], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "mult", "dim", "x", "codes"])

    return run


def _pairs(threshold: float):
    def verify(rows: list[dict], crossed: bool) -> pa.RecordBatch | None:
        x = np.stack([np.frombuffer(r["x"], np.float32 if len(r["x"]) == 4 * r["dim"] else np.float64).astype(np.float64) for r in rows])
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        codes, table = np.array([r["codes"] for r in rows], dtype=np.int32), rows[0]["t"]
        mult, cell = np.array([r["mult"] for r in rows]), np.array([r["cell"] for r in rows])
        label, count = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
        node = np.array([r["node"] for r in rows])
        firsts, seconds = [], []
        for at in range(0, len(rows), 256):
            i, j = np.nonzero(x[at : at + 256] @ x.T >= threshold)
            i += at
            keep = (i < j) & ((cell[i] != cell[j]) if crossed else True)
            i, j = i[keep], j[keep]
            new = (codes[i, :table] != codes[j, :table]).all(axis=1) if table else np.ones(len(i), bool)
            np.add.at(count, i[new], mult[j[new]])
            np.add.at(count, j[new], mult[i[new]])
            firsts.append(i)
            seconds.append(j)
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        while len(i):
            before = label.copy()
            low = np.where(node[label[i]] <= node[label[j]], label[i], label[j])
            order = np.argsort(-node[low], kind="stable")  # the smallest is written last
            for side in (i, j):
                label[side[order]] = np.where(node[low[order]] < node[label[side[order]]], low[order], label[side[order]])
            label = label[label]
            if (before == label).all():
                break
        some = np.nonzero((count > 0) | (label != np.arange(len(rows))))[0]
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(node[label[some]])], ["node", "n", "low"])

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                key = (r["t"], r["dim"], r["code"], r["p"], r["q"])
                if key != held:
                    if len(rows) > 1 and (out := verify(rows, held[3] != held[4])) is not None:
                        yield out
                    held, rows = key, []
                rows.append(r)
        if len(rows) > 1 and (out := verify(rows, held[3] != held[4])) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    keyed = rows.select("vec_id", F.when(sound, F.xxhash64("v")).alias("k1"), F.when(sound, F.xxhash64(F.lit(1), "v")).alias("k2"), F.when(sound, F.col("v")).alias("v"))
    # a node is a distinct vector, numbered once and for all by the written table
    folded = keyed.where(sound).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    folded = cut(folded.withColumn("node", F.monotonically_increasing_id()), "vectors")
    bits, tables = shape(folded.count(), threshold, recall)
    coded = cut(folded.select("node", "mult", "v").mapInArrow(_codes(bits, tables), "node long, mult long, dim int, x binary, codes array<int>"), "codes")
    spread = coded.select("*", F.posexplode("codes").alias("t", "code"))
    full = cut(spread.groupBy("t", "dim", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("t", "dim", "code", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("g")), "overfull")
    grid = spread.join(full, ["t", "dim", "code"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    grid = grid.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    grid = grid.withColumn("p", F.least("cell", "other")).withColumn("q", F.greatest("cell", "other")).drop("other", "g")
    key = ["t", "dim", "code", "p", "q"]
    found = cut(grid.repartition(*key).sortWithinPartitions(*key).mapInArrow(_pairs(threshold), "node long, n long, low long"), "found")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.select("node", "low"))
    known = folded.select("k1", "k2", "node", "rep", "mult").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = cut(known.join(smallest, "component").select("k1", "k2", "n", "mult", "component_id"), "classes")
    drop(folded, coded, full, found)
    out = keyed.drop("v").join(classes, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
