"""Documents of similar five-word shingles, by a parity-sketch join.

Two sets with Jaccard similarity of at least 3/4 differ in at most (|A| + |B|) / 7 shingles.
Every shingle XORs its 64-bit hash into one segment of its document's sketch, which has as many
segments as its band of sizes needs: segments in which two sketches differ are no more than
the differing shingles. So among the segments that hold any shingle, similar documents agree in
all but D, and any common order of the segments puts an agreement among the first D + 1 (the
pigeonhole). Those are joined; the order is by rarity, from a counting sketch of all shingles,
so that passages which many documents share are rarely keys. A document with no more than D
such segments also takes the key of the sparse ones of its band.

Candidates pass a bound on size and bounds on the Hamming distance of parity sketches of one
bit a shingle, 512 bits and, for larger sets, about two bits for each shingle, and are then
compared shingle by shingle. Equal sets are one class from the start. The candidates of a key
are its smallest class with each other one: each class first with the one it meets so most
often, then with the others that are not yet in its component. Where that leaves several
components, all pairs across them that pass the bounds are found. Keys with the same smallest
class, which mostly have the same classes, are one group for this: a class stands in it once,
however many of the keys it has. A hot group is cut into cells, and pairs of cells are the
unit of work. Of the pairs of two components the likeliest is compared first, then those
between components that are still apart. So no link between components is lost, and pairs
inside one are never made. Sketches are compared in the order of a group's classes in other
components times its classes, texts only in pairs that pass.

Shingles are compared by 64-bit hashes. A text with fewer than five words is one shingle of
all of them; one without words, or null, is an empty set and links with nothing. A null
doc_id takes part, but a component is named by its smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.shared import Tables, cut, release, trimmed
from weft.llm.words import word_hashes

WORDS = 5
#: Counters of the sketch of frequencies: a fixed number, in slices.
SLOTS, SLICES = 1 << 20, 32
#: Slots of the filter of wanted classes: eight for each, so many at least and at most; beyond, more texts are looked at.
WANTED = (1 << 16, 1 << 27)
#: Bits of every set's sketch, and of the largest one of a larger set.
BITS, WIDEST = 512, 1 << 20
#: Classes beside one smallest class that are done together; pairs tested at a time; a task keeps so many pairs to tell repeated ones.
TOGETHER, AT_ONCE, PAIRS = 10_000, 200_000, 400_000
#: Members of a star that one task compares with its centre.
STAR = 256
STEP = 500
#: Texts that a task knows to have met; it may forget, at the price of naming one twice.
REMEMBERED = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(h: np.ndarray, k: int = 1) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; another for each k."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[k % 5]
    h = (h ^ (h >> np.uint64(29))) * _ODD[(k + 2) % 5]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; the words of all texts are hashed together."""
    w, first = word_hashes(texts)
    n = np.diff(first)
    grams = np.full(max(0, len(w) - WORDS + 1), WORDS, dtype=np.uint64)
    for i in range(WORDS):
        grams ^= grams >> np.uint64(31)
        grams *= _ODD[0]
        grams += w[i : i + len(grams)]
    grams = mix(grams)
    out = []
    for at, k in zip(first[:-1].tolist(), n.tolist()):
        if k >= WORDS:
            h = np.sort(grams[at : at + k - WORDS + 1])
            new = h[1:] != h[:-1]
            out.append(h if new.all() else h[np.concatenate([[True], new])])
        else:
            h = np.full(min(k, 1), k, dtype=np.uint64)
            for i in range(k):
                h = (h ^ (h >> np.uint64(31))) * _ODD[0] + w[at + i]
            out.append(mix(h))
    return out


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return shingle_sets(pa.array([text], pa.string()))[0]


def class_of(h: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    if not len(h):
        return 0
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes())], dtype=np.uint64).view(np.int64)[0])


def most_different(n: int) -> int:
    """The most shingles in which a set of n differs from a similar one, which has 4 n / 3 at most."""
    return (n + 4 * n // 3) // 7


def bands(n: int) -> list[int]:
    """The bands of sizes in which a set of n meets its partners: that of the larger of two."""
    own = (n.bit_length() - 1) // 2
    return [own, own + 1] if 4 * n // 3 >= 4 ** (own + 1) else [own]


def keys(h: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The join keys of a set: for each band the rarest D + 1 of its parts."""
    out, need = [], most_different(len(h)) + 1
    for band in bands(len(h)):
        part = (h >> np.uint64(20)) % np.uint64(4 ** (band + 1))
        order = np.argsort(part, kind="stable")
        part, own = part[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        parity = np.bitwise_xor.reduceat(mix(own, 3), first)
        name = mix(parity + mix(part[first] * np.uint64(64) + np.uint64(band), 2), 4)
        if len(first) < need:
            out.append(np.append(name, mix(np.array([band], dtype=np.uint64), 3)))
        else:
            rare = np.minimum.reduceat(rarity[(own >> np.uint64(44)) % np.uint64(SLOTS)], first)
            out.append(name[np.lexsort((name, rare))[:need]])
    return np.concatenate(out)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP))


def _sliced(counts: np.ndarray) -> list[tuple[int, bytes]]:
    z = zstandard.ZstdCompressor(1)
    return [(k, z.compress(np.ascontiguousarray(x).tobytes())) for k, x in enumerate(np.split(counts, SLICES)) if x.any()]


SURVEY = "doc_id long, h long, n int, cls long, s array<long>, w array<long>, slice int, counts binary"
_KINDS = [("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("s", pa.list_(pa.int64())), ("w", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())]


def parities(h: np.ndarray) -> tuple[list[int], list[int] | None]:
    """Sketches of one bit a shingle, in 64-bit words: of BITS bits, and for larger sets of the next power of two above twice its size."""

    def packed(bits: int) -> np.ndarray:
        flips = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)

    if len(h) <= BITS:
        return packed(BITS).tolist(), None
    wide = packed(min(WIDEST, 1 << (2 * len(h) - 1).bit_length()))
    return np.bitwise_xor.reduce(wide.reshape(-1, BITS // 64), axis=0).tolist(), wide.tolist()


@trimmed()
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end of a partition its counts of shingles."""
    counts, schema = np.zeros(SLOTS, dtype=np.uint32), pa.schema(_KINDS)
    for b in _steps(batches):
        sets = shingle_sets(b["text"])
        every = np.concatenate(sets)
        counts += np.bincount(((every >> np.uint64(44)) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        s, w = zip(*map(parities, sets), strict=True)
        size = len(sets)
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["h"], pa.array([len(h) for h in sets], pa.int32()), pa.array([class_of(h) for h in sets], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (s, w)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
            schema=schema,
        )
    rows = _sliced(counts)
    if rows:
        empty = [pa.nulls(len(rows), kind) for _, kind in _KINDS[:6]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], schema=schema)


def _add_slices(kind: str, finish: str):
    """Sums of slices: counters of ``kind`` in, ``finish`` of them out; a task has few slices at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, sums = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, c in zip(b["slice"].to_pylist(), b["counts"].to_pylist(), strict=True):
                own = np.frombuffer(z.decompress(c), dtype=kind)
                sums[k] = sums[k] + own.astype(np.uint64) if k in sums else own.astype(np.uint64)
        for k, c in sums.items():
            small = np.minimum(np.log2(1 + c) * 6, 255).astype(np.uint8) if finish == "rarity" else np.packbits(c > 0)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["slice", "counts"])

    return run


def _gather(slices: DataFrame, kind: str, finish: str, width: int) -> np.ndarray:
    """The summed slices on the driver: a fixed number of bytes, whatever the input."""
    rows = slices.repartition(SLICES, "slice").mapInArrow(_add_slices(kind, finish), "slice int, counts binary").collect()
    have = {r.slice: np.frombuffer(bytes(r.counts), dtype=np.uint8) for r in rows}
    return np.concatenate([have.get(k, np.zeros(width // SLICES, dtype=np.uint8)) for k in range(SLICES)])


def _emit_keys(rarity):
    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(rarity.value, dtype=np.uint8), set()
        for b in _steps(batches):
            found, owners = [], []
            for h in shingle_sets(b["text"]):
                name = class_of(h)
                if len(h) and name not in seen:  # a task names the keys of equal sets once
                    seen.add(name) if len(seen) < REMEMBERED else seen.clear()
                    own = keys(h, table).view(np.int64)
                    found.append(own)
                    owners.append(np.full(len(own), name, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(owners))], ["key", "cls"])

    return run


@trimmed()
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, low, cls, alone): the classes of a key beside its smallest; rows come in order of key and class.

    alone: there is surely no other such class in the key.
    """
    last = (None, None, None)  # key, its smallest class, class
    for b in batches:
        key, cls = b["key"].to_numpy(), b["cls"].to_numpy()
        if not len(key):
            continue
        goes_on = key[0] == last[0]
        head = np.concatenate([[not goes_on], key[1:] != key[:-1]])
        new = np.concatenate([[goes_on and cls[0] != last[2]], (key[1:] == key[:-1]) & (cls[1:] != cls[:-1])])
        heads = np.flatnonzero(head)
        at = np.cumsum(head) - 1
        low = np.where(at < 0, np.int64(last[1] if goes_on else 0), cls[heads[np.maximum(at, 0)]] if len(heads) else cls)
        last = (key[-1], low[-1], cls[-1])
        if new.any():
            key, low, cls = key[new], low[new], cls[new]
            same = np.concatenate([[True], key[1:] == key[:-1], [True]])  # what the batches beside hold is not known
            alone = ~(same[1:] | same[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(low), pa.array(cls), pa.array(alone)], ["key", "low", "cls", "alone"])


PAIR = "a long, b long, x long, y long, apart double"


def _cross(likeliest: bool):
    """The pairs of a group's classes that lie in different components and pass the bounds; or of each two components the likeliest.

    Rows come in order of (low, p, q, component): the cells p and q of a group, crossed with each other.
    """

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _crossed(batches, likeliest)

    return run


def _crossed(batches: Iterator[pa.RecordBatch], likeliest: bool) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []

    def once() -> pa.RecordBatch:
        a, b, x, y, apart = (np.concatenate([f[c] for f in found]) for c in range(5))
        order, one, two = (np.lexsort((b, a, apart, y, x)), x, y) if likeliest else (np.lexsort((b, a)), a, b)
        order = order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])]
        return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (a, b, x, y, apart)], ["a", "b", "x", "y", "apart"])

    def test(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        n, m = rows["n"][i], rows["n"][j]
        some = (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (rows["component"][i] != rows["component"][j]) & ((rows["p"][i] == rows["q"][i]) | (rows["cell"][i] != rows["cell"][j]))
        i, j, both = i[some], j[some], (n + m)[some]
        apart = np.bitwise_count(rows["s"][i] ^ rows["s"][j]).sum(axis=1, dtype=np.int64)
        some = 7 * apart <= both
        i, j, apart = i[some], j[some], apart[some] / both[some]
        if len(i):
            (c, d), (x, y) = ((rows[k][i], rows[k][j]) for k in ("cls", "component"))
            found.append((np.minimum(c, d), np.maximum(c, d), np.minimum(x, y), np.maximum(x, y), apart))

    def whole(rows: dict[str, np.ndarray], head: np.ndarray) -> None:
        """All pairs across components inside groups that begin at head: a row meets those behind its own component's."""
        size = len(rows["n"])
        if not size:
            return
        starts = np.zeros(size, dtype=bool)
        starts[head] = True
        ends = np.repeat(np.append(head[1:], size), np.diff(np.append(head, size)))
        block = np.flatnonzero(starts | np.concatenate([[True], rows["component"][1:] != rows["component"][:-1]]))
        behind = np.repeat(np.append(block[1:], size), np.diff(np.append(block, size)))
        before = np.concatenate([[0], np.cumsum(ends - behind)])
        begin = 0
        while begin < size:
            end = max(begin + 1, int(np.searchsorted(before, before[begin] + AT_ONCE, side="right")) - 1)
            i = np.repeat(np.arange(begin, end), np.diff(before[begin : end + 1]))
            test(rows, i, behind[i] + np.arange(before[begin], before[end]) - before[i])
            begin = end

    held: dict[str, np.ndarray] | None = None
    for b in batches:
        rows = {c: b[c].to_numpy() for c in ("low", "p", "q", "cls", "component", "cell", "n")} | {"s": b["s"].flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        if not len(rows["n"]):
            continue
        head = np.flatnonzero(np.concatenate([[True], np.any([rows[c][1:] != rows[c][:-1] for c in ("low", "p", "q")], axis=0)]))
        held = {c: v[head[-1] :] for c, v in rows.items()}  # it may go on
        whole({c: v[: head[-1]] for c, v in rows.items()}, head[:-1])
        if sum(len(f[0]) for f in found) > PAIRS:
            out = once()
            found.clear()
            if out.num_rows > PAIRS // 2:
                yield out
            else:
                found.append(tuple(c.to_numpy() for c in out.columns))
    if held is not None:
        whole(held, np.zeros(1, dtype=np.int64))
    if found:
        yield once()


def _mark(slots: int):
    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(slots, dtype=np.uint8)
        for b in batches:
            marks[b["h"].to_numpy().view(np.uint64) % np.uint64(slots)] = 1
        rows = _sliced(marks)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["slice", "counts"])

    return run


def _emit_sets(wanted, slots: int):
    """The sets of texts whose hash is marked; the others are not even looked at."""

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = np.frombuffer(wanted.value, dtype=np.uint8), set()
        for b in batches:
            at = b["h"].to_numpy().view(np.uint64) % np.uint64(slots)
            b = b.filter(pa.array((marks[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0))
            for part in _steps([b]):
                new = []
                for k, h in enumerate(part["h"].to_pylist()):
                    if h not in seen:
                        new.append(k)
                        seen.add(h) if len(seen) < REMEMBERED else seen.clear()
                sets = [x for x in shingle_sets(part["text"].take(pa.array(new, pa.int64()))) if len(x)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "h"])

    return run


@trimmed()
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the members that resemble their star's centre; the centre's set comes first."""
    star, centre, last = None, None, None
    for b in batches:
        out = []
        for own, salt, first, cls, h in zip(*(b[k].to_pylist() for k in ("star", "salt", "centre", "cls", "h")), strict=True):
            if (own, salt) != star:
                star, centre, last = (own, salt), None, None
            if first:
                centre = np.frombuffer(h, dtype=np.uint64)
            elif cls != last:
                last, x = cls, np.frombuffer(h, dtype=np.uint64)
                both = len(np.intersect1d(x, centre, assume_unique=True))
                if 100 * both >= 75 * (len(x) + len(centre) - both):
                    out.append((own, cls))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def _apart(x: str, y: str):
    """The Hamming distance of two classes' sketches."""
    return sum((F.bit_count(F.col(f"{x}.s")[k].bitwiseXOR(F.col(f"{y}.s")[k])) for k in range(BITS // 64)), F.lit(0))


def _possible(x: str, y: str):
    """Bounds on sizes and on the Hamming distance of the sketches, as a join condition."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * _apart(x, y) <= n + m)


def _possible_wide(x: str, y: str):
    """The same bound by the wide sketches of larger sets; of two sizes the larger is folded."""
    a, b = F.col(f"{x}.w"), F.col(f"{y}.w")
    half = lambda v: F.floor(F.size(v) / 2).cast("int")
    folded = lambda v: F.zip_with(F.slice(v, F.lit(1), half(v)), F.slice(v, half(v) + 1, half(v)), lambda p, q: p.bitwiseXOR(q))
    fit = lambda v, o: F.when(F.size(v) > F.size(o), folded(v)).otherwise(v)
    apart = F.aggregate(F.zip_with(fit(a, b), fit(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    return a.isNull() | b.isNull() | (7 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n"))


def _compare(docs: DataFrame, pairs: DataFrame, info: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar; info names a text of each class by its hash."""
    spark = docs.sparkSession
    classes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    named = tables.cut(info.select("cls", "h").join(classes, "cls", "left_semi").select("h"), "wanted")
    slots = min(WANTED[1], max(WANTED[0], 1 << (8 * named.count()).bit_length()))
    wanted = spark.sparkContext.broadcast(_gather(named.mapInArrow(_mark(slots), "slice int, counts binary"), "uint8", "wanted", slots // 8).tobytes())
    sets = docs.select("h", "text").mapInArrow(_emit_sets(wanted, slots), "cls long, h binary")
    # a star's centre goes to as many places as its members need, a member once for each of its pairs
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    dealt = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = dealt.select(F.col("b").alias("cls"), F.col("a").alias("star"), "salt", F.lit(False).alias("centre"))
    centres = dealt.select(F.col("a").alias("cls"), F.col("a").alias("star"), "salt", F.lit(True).alias("centre")).distinct()
    routed = sets.join(members.unionAll(centres), "cls").repartition("star", "salt").sortWithinPartitions("star", "salt", F.desc("centre"), "cls")
    out = tables.cut(routed.select("star", "salt", "centre", "cls", "h").mapInArrow(_verify, "a long, b long"), "links")
    tables.drop(named)
    return out


def _labelled(rows: DataFrame, named: DataFrame, by: str, label: str) -> DataFrame:
    """Rows with the component of the class in column ``by``; a class without links is its own."""
    return rows.join(named.select(F.col("node").alias(by), F.col("component").alias(label)), by, "left").withColumn(label, F.coalesce(label, by))


def similar(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the hash h of its text, and its component.

    The component is the class that names it, null for a document without words; unlike
    component_id it tells groups apart whatever their doc_ids.

    Texts are read, never shuffled. Shuffled are about n / 3 keys of 16 bytes for a set of n,
    and the sets of classes that have a candidate. To the driver come two tables of fixed
    size, the rarity of shingles and the filter of wanted classes.
    """
    with Tables() as tables:
        return _similar(documents, tables)


def _similar(documents: DataFrame, tables: Tables) -> DataFrame:
    spark, cut = documents.sparkSession, tables.cut
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    survey = cut(docs.mapInArrow(_survey, SURVEY), "survey")
    rarity = spark.sparkContext.broadcast(_gather(survey.where("slice is not null").select("slice", "counts"), "uint32", "rarity", SLOTS).tobytes())
    rows = survey.where("slice is null").select("doc_id", "h", "n", "cls", "s", "w")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("w").alias("w"), F.min("h").alias("h"))
    keyed = docs.select("text").mapInArrow(_emit_keys(rarity), "key long, cls long")
    stars = cut(keyed.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_stars, "key long, low long, cls long, alone boolean"), "stars")
    release(spark)
    info = cut(classes.join(stars.select(F.explode(F.array("low", "cls")).alias("cls")).distinct(), "cls", "left_semi"), "classes")
    found: list[DataFrame] = []

    def compared(pairs: DataFrame) -> DataFrame | None:
        """The components with the links among these pairs; None if none of them can be one."""
        sized = pairs.join(info.alias("p"), F.col("a") == F.col("p.cls")).join(info.alias("q"), (F.col("b") == F.col("q.cls")) & _possible("p", "q") & _possible_wide("p", "q"))
        candidates = cut(sized.select("a", "b"), "candidates")
        if found and candidates.isEmpty():
            return None
        found.append(_compare(docs, candidates, info, tables))
        tables.drop(candidates)
        links = found[0]
        for more in found[1:]:
            links = links.unionAll(more)
        return components(links, tables)

    # first each class with the one that is smallest for most of its keys, which settles most groups of copies
    shared = cut(stars.groupBy("cls", "low").agg(F.count(F.lit(1)).alias("k"), F.bool_and("alone").alias("alone")), "shared")
    best = shared.groupBy("cls").agg(F.max(F.struct("k", "low")).alias("top")).select(F.col("top.low").alias("a"), F.col("cls").alias("b"))
    named = compared(best)
    # then with the others of which it is not yet known
    apart = _labelled(_labelled(shared.select("low", "cls"), named, "low", "x"), named, "cls", "y").where("x != y")
    named = compared(apart.select(F.col("low").alias("a"), F.col("cls").alias("b"))) or named
    # and all pairs of a group that still lie in different components, once the likeliest of each two components are known
    nearest = _across(shared, named, info, tables, True).groupBy("x", "y").agg(F.min_by(F.struct("a", "b"), "apart").alias("pair")).select("pair.*")
    named = compared(nearest) or named
    named = compared(_across(shared, named, info, tables, False).select("a", "b").distinct().join(nearest, ["a", "b"], "left_anti")) or named
    lowest = classes.select("cls", "doc_id").join(named.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = lowest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = cut(lowest.join(least, "component").select("cls", "component", "component_id"), "components")
    tables.keep(survey, by_class)
    out = rows.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(by_class, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "h", "component")


def _across(shared: DataFrame, named: DataFrame, info: DataFrame, tables: Tables, likeliest: bool) -> DataFrame:
    """(a, b, x, y, apart): pairs of classes with keys of the same smallest class that pass the bounds, from the different components x and y.

    The smallest class was compared with all others, and is not among them. Where it has many
    beside it, they are dealt into cells.
    """
    members = _labelled(shared.where("not alone").select("low", "cls"), named, "cls", "component")
    mixed = members.groupBy("low").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(2 * F.count(F.lit(1)) / TOGETHER).cast("int").alias("g"))
    cells = F.when(F.col("g") > 2, F.col("g")).otherwise(1)
    rows = members.join(mixed.where("x != y").select("low", cells.alias("g")), "low").join(info.select("cls", "n", "s"), "cls")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("low", F.least("cell", "other").alias("p"), F.greatest("cell", "other").alias("q"), "cls", "component", "cell", "n", "s")
    dealt = rows.repartition("low", "p", "q").sortWithinPartitions("low", "p", "q", "component")
    return tables.cut(dealt.mapInArrow(_cross(likeliest), PAIR), "across")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, same columns, one of each group of similar ones.

    Of a group the row of the smallest doc_id stays, of its rows the one whose text has the
    smallest hash; a null doc_id comes last. Groups are told apart by their sets of shingles,
    so unlike documents stay also where their doc_ids are null or equal. A document without
    words is in no group and always stays. Columns may have any names.
    """
    none = F.lit(-(2**63))
    docs = documents.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"), F.coalesce(F.col("doc_id").cast("long"), none).alias("i"))
    found = cut(similar(documents), "similar")
    release(documents.sparkSession)
    grouped = found.where("n_shingles > 0")
    stay = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")).alias("top")).select("top.*")
    stay = stay.select(F.coalesce("doc_id", none).alias("i"), "h")
    worded = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(worded).join(stay.distinct(), ["i", "h"], "left_semi").dropDuplicates(["i", "h"])
    return kept.select("row.*").unionAll(docs.where(~worded).select("row.*"))
