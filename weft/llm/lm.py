"""Language-model scores from an n-gram trie that is spread over shards.

Words get numbers and counts in shards by hash. Then there is a round for each order from 2:
every block of documents sends its (context, word) pairs to the shards of those pairs, where
a context is the number of the n-gram before the word; a shard adds up the training counts
and builds its part of the trie's level, Elias-Fano sequences with smoothed probabilities.
In all rounds but the last it answers number, count and probability of each pair, by which
the block names its contexts of the next order; in the last the sum over each document's
pairs, found by successor search relative to the context. No task holds more than a block of
documents or a shard of pairs; both are of a set size, their number grows.

p(w | c) = (c(cw) + MU p(w | d)) / (c(c) + MU), where d is the context c without its first
word, and p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Before a document stands its start, as
often as the order needs. p(w | d) travels as a 16-bit code where d is not empty. A frequent
context is spread over shards by its words, in proportion to its count.

Words are runs without ASCII white space, A-Z in lower case; one end follows a text. They are
told apart by 64-bit hashes. A null text is empty; rows that repeat count as often as they
stand; a null doc_id is scored, and trains nothing.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.eliasfano import Trie, quantise
from weft.llm.shared import LOWER, cut, drop, drop_part, parted, release, singly, text_bytes, trimmed

MU = 16.0
#: Words of an n-gram, the scored word among them.
ORDER = 3
#: Tokens of a block of documents; text bytes to a shard of the model.
BLOCK, SHARD_BYTES = 1_500_000, 12 << 20
#: Pairs of a context go to one more shard for each so many of its tokens.
SPREAD = 100_000
#: Blocks ask, and shards answer, in one more slice for each so many text bytes, in so many at most.
SLICE_BYTES, SLICES = 200 << 20, 4
END, START = (xxhash.xxh64_intdigest(x) for x in (b"", b"\n"))  # no word is empty or white space


def _z(a: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane, which suits small ones."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def _un(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _za(a: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return _z(np.diff(a, prepend=a.dtype.type(0)))


def _una(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(_un(blob, kind), dtype=kind)


BLOCKS = "block long, doc_id array<long>, train binary, sizes binary, tokens binary, words binary, counts binary"
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@trimmed()
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of the block's own words, in order of their first use.

    A task's blocks are numbered one after another, the first by its partition in the low bits, so
    that slices get about equally many.
    """

    def done() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        flags = np.array(train, dtype=bool)
        counts = np.bincount(tokens[np.repeat(flags, sizes)], minlength=len(numbers)).astype(np.uint32)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)
        row = [[block], [ids], [flags.astype(np.uint8).tobytes()], [_z(np.array(sizes, dtype=np.uint32))], [_z(tokens)], [_z(hashes)], [_z(counts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    numbers, ids, train, sizes, held = _Numbers(), [], [], [], []
    task = TaskContext.get()
    many, block = 0, secrets.randbits(46) << 16 | (task.partitionId() & 0xFFFF if task else 0)
    for b in batches:
        for doc_id, text, trains in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "train")), strict=True):
            words = (text or "").encode().translate(LOWER).split()
            words.append(b"")
            own = np.array([numbers[w] for w in words], dtype=np.uint32)
            ids.append(doc_id)
            train.append(bool(trains))
            sizes.append(len(own))
            held.append(own)
            many += len(own)
            if many >= BLOCK:
                yield done()
                numbers, ids, train, sizes, held, many, block = _Numbers(), [], [], [], [], 0, block + 1
    if ids:
        yield done()


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard and hash, and where each shard begins in it."""
    shard = (hashes >> np.uint64(20)) % np.uint64(shards)
    order = np.lexsort((hashes, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def _ask_words(shards: int):
    """A block's words and training counts, to the shards of the words."""

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, counts in zip(*(b[c].to_pylist() for c in ("block", "words", "counts")), strict=True):
                hashes, counts = _un(words, np.uint64), _un(counts, np.uint32)
                order, begin = _by_shard(hashes, shards)
                hashes, counts = hashes[order], counts[order]
                some = np.flatnonzero(np.diff(begin))
                part = lambda a: pa.array([_z(a[begin[s] : begin[s + 1]]) for s in some], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), part(hashes), part(counts)], ["shard", "block", "words", "counts"])

    return run


def _rows_by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with equal keys."""
    held, rows = None, []
    for row in singly(batches):
        if rows and row[key] != held:
            yield held, rows
            rows = []
        held = row[key]
        rows.append(row)
    if rows:
        yield held, rows


def _answer_words(shards: int):
    """Numbers and counts of a shard's words, to every block that asked; and the shard's N and V."""

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _rows_by(batches, "shard"):
            asked = [_un(r["words"], np.uint64) for r in rows]
            words, which = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(which, np.concatenate([_un(r["counts"], np.uint32) for r in rows]), len(words)).astype(np.int64)
            rank = np.empty(len(words), dtype=np.uint64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.uint64)
            number = rank * np.uint64(shards) + np.uint64(shard + 1)
            if int(number.max()) >= 1 << 32:
                raise ValueError("more than 2**32 distinct words")
            at = np.split(which, np.cumsum([len(a) for a in asked])[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"] for r in rows] + [None], pa.int64()), pa.array([shard] * (len(rows) + 1), pa.int32()), pa.array([_z(number[a].astype(np.uint32)) for a in at] + [None], pa.binary()),
                 pa.array([_z(counts[a].astype(np.uint32)) for a in at] + [None], pa.binary()), pa.array([0] * len(rows) + [int(counts.sum())], pa.int64()), pa.array([0] * len(rows) + [int((counts > 0).sum())], pa.int64())],
                ["block", "shard", "numbers", "counts", "n", "v"],
            )

    return run


ROUTED = "route long, block long, context binary, heads binary, totals binary, word binary, lowers binary, owner binary, doc_id array<long>, rows binary"
_ROUTED = pa.schema([("route", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("context", "heads", "totals", "word", "lowers", "owner")), ("doc_id", pa.list_(pa.int64())), ("rows", pa.binary())])
#: Of every document: tokens, known tokens, base score, score by the order before the last.
FACTS = np.dtype([("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("lower", "<f8")])
STEP = Trie.LOWEST / 65535


def _pairs(gram: np.ndarray, count: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: int, shards: int):
    """A block's (context, word) pairs in order of shard, context and word.

    The contexts, their totals, the order of the tokens, where each shard begins in it, and
    for each of its places whether a pair of the block begins there.
    """
    context, total = np.roll(gram, 1), np.roll(count, 1)
    context[starts], total[starts] = 0, ends
    spread = (word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % (1 + total // SPREAD).astype(np.uint64)
    shard = (((context * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)) + spread) % np.uint64(shards)).astype(np.uint32)
    del spread
    # two sorts of 64-bit keys; contexts beyond 32 bits by their rank in the block
    low = context if not len(context) or int(context.max()) < 1 << 32 else np.unique(context, return_inverse=True)[1].astype(np.uint64)
    key = (low << np.uint64(32)) | word
    del low
    first = np.argsort(key, kind="stable")
    first = first[np.argsort(shard[first], kind="stable")]
    key, cuts = key[first], np.searchsorted(shard[first], np.arange(shards + 1))
    new = np.concatenate([[True], key[1:] != key[:-1]])  # a pair is in one shard
    return context, total, first, cuts, new


def _ask_pairs(shards: int, n: int, v: int, order: int, last: bool):
    """A block's pairs of an order to their shards; in the last round also its documents' facts to where their sums will meet."""
    bottom = n + 0.1 * (v + 1)

    def one(block: dict, answers: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        hashes = _un(block["words"], np.uint64)
        by, begin = _by_shard(hashes, shards)
        number, count = np.empty(len(hashes), dtype=np.uint64), np.empty(len(hashes), dtype=np.int64)
        for a in answers[1]:
            at = by[begin[a["shard"]] : begin[a["shard"] + 1]]
            number[at], count[at] = _un(a["numbers"], np.uint32), _un(a["counts"], np.uint32)
        tokens, sizes = _un(block["tokens"], np.uint32), _un(block["sizes"], np.uint32).astype(np.int64)
        train, docs = np.frombuffer(block["train"], dtype=np.uint8), len(sizes)
        owner = np.repeat(np.arange(docs, dtype=np.uint32), sizes)
        starts = np.cumsum(sizes) - sizes
        facts = np.zeros(docs, dtype=FACTS)
        facts["tokens"] = sizes
        facts["known"] = np.bincount(owner, (count > 0)[tokens], docs)
        facts["base"] = facts["lower"] = np.add.reduceat(np.log10((count + 0.1) / bottom)[tokens], starts) if docs else 0
        word, own_count = number[tokens], count[tokens]
        del hashes, by, number, count, tokens
        ends = int(own_count[starts[0] + sizes[0] - 1])  # every document that trains has one end, and one start
        # what stands before a word: the number and count of the n-gram that ends there, longer round by round
        gram, grams, lowers = word, own_count, own_count.astype(np.uint32)
        del own_count
        for k in range(2, order):
            *_, first, cuts, new = _pairs(gram, grams, word, starts, ends, shards)
            pair = np.cumsum(new) - 1
            names, counts, codes = np.empty(pair[-1] + 1, dtype=np.uint64), np.empty(pair[-1] + 1, dtype=np.int64), np.empty(pair[-1] + 1, dtype=np.uint16)
            for a in answers[k]:
                own = slice(pair[cuts[a["shard"]]], pair[cuts[a["shard"] + 1] - 1] + 1)
                names[own] = _una(a["numbers"], np.uint32).astype(np.uint64) * np.uint64(shards) + np.uint64(a["shard"] + 1)
                counts[own], codes[own] = _un(a["counts"], np.uint32), _un(a["codes"], np.uint16)
            gram, grams, lowers = np.empty_like(word), np.empty(len(word), dtype=np.int64), np.empty(len(word), dtype=np.uint16)
            gram[first], grams[first], lowers[first] = names[pair], counts[pair], codes[pair]
            del _, first, new, pair, names, counts, codes
        if order > 2:
            facts["lower"] = np.add.reduceat(lowers * STEP, starts)
        context, total, first, cuts, new = _pairs(gram, grams, word, starts, ends, shards)
        del gram, grams
        trains = train[owner[first]]
        if last:
            owner = (owner[first] << np.uint32(1)) | trains
        else:  # each pair once, with its training count in the block
            at = np.flatnonzero(new)
            owner, first, cuts = np.add.reduceat(trains, at, dtype=np.uint32), first[at], np.searchsorted(at, cuts)
        context, word, total, lowers = context[first], word[first], total[first], lowers[first]
        columns: list[list] = [[] for _ in _ROUTED]
        for s in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[s], cuts[s + 1])
            c = context[own]
            new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            row = [int(s), block["block"], _z(np.diff(np.append(new, len(c))).astype(np.uint32)), _za(c[new]), _z(total[own][new].astype(np.uint32)), _z(word[own].astype(np.uint32)), _z(lowers[own]), _z(owner[own]), None, None]
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        if last:
            for column, x in zip(columns, [-1 - block["block"], block["block"], *[None] * 6, block["doc_id"], facts.tobytes()], strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _rows_by(batches, "block"):
            (block,) = (r for r in rows if r["tokens"] is not None)
            yield from one(block, {k: [r for r in rows if r["round"] == k] for k in range(1, order)})

    return run


PAIRS = "block long, shard int, numbers binary, counts binary, codes binary"
SUMS = "block long, doc_id array<long>, rows binary, docs binary, sums binary"


def _answer_pairs(n: int, v: int, order: int, last: bool):
    """A shard's part of an order's level, and what it says of each block's pairs.

    That is number, training count and coded log10 p of each; in the last round the sums by
    document of log10 p less that of the order before.
    """
    bottom = n + 0.1 * (v + 1)

    def one(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        heads = [_una(r["heads"], np.uint64) for r in rows]
        runs = [_un(r["context"], np.uint32) for r in rows]
        names, at, head = np.unique(np.concatenate(heads), return_index=True, return_inverse=True)
        key = np.repeat(head, np.concatenate(runs)).astype(np.uint64) << np.uint64(32)
        key |= np.concatenate([_un(r["word"], np.uint32) for r in rows])
        del heads, runs, head
        lowers = np.concatenate([_un(r["lowers"], np.uint32 if order == 2 else np.uint16) for r in rows])
        owners = [_un(r["owner"], np.uint32) for r in rows]
        pairs, first, which = np.unique(key, return_index=True, return_inverse=True)
        del key
        count = np.bincount(which, np.concatenate([o & 1 if last else o for o in owners]), len(pairs))
        base = np.log10((lowers[first] + 0.1) / bottom) if order == 2 else lowers[first] * STEP
        above, word = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
        total = np.concatenate([_un(r["totals"], np.uint32) for r in rows])[at].astype(np.float64)
        seen = count > 0
        smooth = np.log10((count[seen] + MU * 10 ** base[seen]) / (total[above[seen]] + MU))
        del first, lowers
        trie = Trie(names[above[seen]], word[seen], smooth, names, np.log10(MU / (total + MU)))
        del smooth, seen
        logs = trie.logs(names[above], word, base)
        if not last:
            begin, codes = 0, quantise(logs, Trie.LOWEST)
            for r, own in zip(rows, owners, strict=True):
                w = which[begin : begin + len(own)]
                begin += len(own)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["route"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (_za(w.astype(np.uint32)), _z(count[w].astype(np.uint32)), _z(codes[w])))], ["block", "shard", "numbers", "counts", "codes"])
            return
        gain, begin = logs - base, 0
        del pairs, above, word, base, logs, count, trie
        for r, own in zip(rows, owners, strict=True):
            docs, place = np.unique(own >> 1, return_inverse=True)
            sums = np.bincount(place, gain[which[begin : begin + len(own)]], len(docs))
            begin += len(own)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([_z(docs)], pa.binary()), pa.array([_z(sums.astype(np.float32))], pa.binary())], ["block", "doc_id", "rows", "docs", "sums"])

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, rows in _rows_by(batches, "route"):
            if route >= 0:
                yield from one(rows)
                continue
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["doc_id"]], pa.list_(pa.int64())), pa.array([r["rows"]], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], ["block", "doc_id", "rows", "docs", "sums"])

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


@trimmed()
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents with the sums from all shards."""
    for _, rows in _rows_by(batches, "block"):
        (head,) = (r for r in rows if r["rows"] is not None)
        facts = np.frombuffer(head["rows"], dtype=FACTS)
        score = facts["lower"].copy()
        for r in sorted((r for r in rows if r["rows"] is None), key=lambda r: r["docs"] + r["sums"]):
            score[_un(r["docs"], np.uint32)] += _un(r["sums"], np.float32)
        columns = [pa.array(head["doc_id"], pa.int64()), pa.array(facts["tokens"].copy()), pa.array(facts["known"].copy()), pa.array(facts["base"].copy()), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])


def score(docs: DataFrame, train: Column, order: int = 2) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which documents the model learns from, ``order`` of how many words its
    n-grams are, 2 at least. To the driver come two numbers, the tokens and the distinct words
    of training.
    """
    if order < 2:
        raise ValueError("an order below 2 has no context")
    spark = docs.sparkSession
    size = text_bytes(docs)
    shards, slices = max(4, size // SHARD_BYTES), min(SLICES, 1 + size // SLICE_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    slice_of = lambda key: F.coalesce(F.pmod(key, F.lit(slices)), F.lit(0)).cast("int")
    sliced = lambda df, key, name: cut(parted(df.withColumn("slice", slice_of(key)), "slice"), name)
    blocks = sliced(rows.mapInArrow(_blocks, BLOCKS), "block", "blocks")
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask_words(shards), "shard int, block long, words binary, counts binary")
    dealt = asked.repartition("shard").sortWithinPartitions("shard")
    answers = sliced(dealt.mapInArrow(_answer_words(shards), "block long, shard int, numbers binary, counts binary, n long, v long"), "block", "words")
    release(spark)
    n, v = (int(x or 0) for x in answers.agg(F.sum("n"), F.sum("v")).collect()[0])
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    given, said = ("doc_id", "train", "sizes", "tokens", "words"), ("numbers", "counts", "codes")
    asking = blocks.select("block", none("round", "int"), none("shard", "int"), *(none(c, "binary") for c in said), *given, "slice")
    told = answers.where("block is not null").withColumn("codes", none("codes", "binary"))
    sides, tables = [asking], [blocks, answers]
    for k in range(2, order + 1):
        sides.append(told.select("block", F.lit(k - 1).alias("round"), "shard", *said, none("doc_id", "array<long>"), *(none(c, "binary") for c in given[1:]), "slice"))
        last = k == order
        routed, level = [], []
        for at in range(slices):
            some = reduce(DataFrame.unionAll, (side.where(F.col("slice") == at) for side in sides)).drop("slice")
            some = some.repartition("block").sortWithinPartitions("block")
            routed.append(sliced(some.mapInArrow(_ask_pairs(shards, n, v, k, last), ROUTED), "route", "asked"))
            if last:
                drop_part(at, *tables)
            release(spark)
        if last:
            drop(*tables)
        for at in range(slices):
            some = reduce(DataFrame.unionAll, (t.where(F.col("slice") == at) for t in routed)).drop("slice")
            dealt = some.repartition("route").sortWithinPartitions("route")
            met = dealt.mapInArrow(_answer_pairs(n, v, k, last), SUMS if last else PAIRS)
            level.append(cut(met, "further" if at else "sums") if last else sliced(met, "block", "pairs"))
            drop_part(at, *routed)
            release(spark)
        drop(*routed)
        told = reduce(DataFrame.unionAll, level)
        tables += level
    out = told.repartition("block").sortWithinPartitions("block").mapInArrow(_meet, SCORES)
    out = cut(out, "scores")
    drop(*level)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(parts: int = 10, part: int = 0) -> Column:
    """Whether a document is kept from training, by the checksum of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))
