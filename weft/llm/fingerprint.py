"""Document fingerprints by canonical exact digest.

A text is normalised (NFKC), case-folded and its white space folded; the 128-bit xxHash of
that form is the fingerprint. Inside a bucket of equal hashes the canonical bytes are
compared; if two forms ever share a hash, every member of the bucket gets a SHA-256 of its
form appended, so that equal fingerprints of documents always mean equal canonical texts.
The buckets are made of the documents' forms alone: an edited text is told apart from what
shares its hash only where documents clash there, else by the 128 bits of the hash.

Nulls: a null text is the empty text; a null doc_id sorts after all others. Ties of doc_id
are ordered by the text's hash; rows that are wholly equal are interchangeable.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import cut, interval, release, trimmed

#: Texts of one bucket of the document order; more buckets only cost a little bookkeeping.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 8 << 20, 64, 16_384

#: Rows that a task unpacks at once.
STEP = 500


def canonical(text: str) -> str:
    """The form that is hashed: NFKC, case-folded, runs of white space as one space."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(form: bytes) -> bytes:
    return xxhash.xxh3_128_digest(form)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@trimmed()
def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(3)
    for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
        packed = pa.array([z.compress((t or "").encode()) for t in b["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b["bucket"], b["ghost"], b["doc_id"], b["h"], packed], ["bucket", "ghost", "doc_id", "h", "z"])


ROWS = "doc_id long, n_chars long, edited_sha256 binary, h binary, eh binary, wide binary, edited_wide binary, near_edited double, near_next double"


@trimmed()
def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it in its bucket; ghosts only end a bucket."""
    unpack = zstandard.ZstdDecompressor()
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.float64(), pa.float64()]
    held = None
    for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
        out = []
        for bucket, ghost, doc_id, z in zip(*(b[c].to_pylist() for c in ("bucket", "ghost", "doc_id", "z")), strict=True):
            text = unpack.decompress(z).decode()
            form = canonical(text).encode()
            if held is not None and held[0] == bucket:
                _, own_id, own, own_form = held
                new = edited(own, text)
                new_form = canonical(new).encode()
                out.append((own_id, len(own), hashlib.sha256(new.encode()).digest(), digest(own_form), digest(new_form),
                            hashlib.sha256(own_form).digest(), hashlib.sha256(new_form).digest(), float(own_form == new_form), float(own_form == form)))
            held = None if ghost else (bucket, doc_id, text, form)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


@trimmed()
def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's hash and compressed canonical form; a task sends a repeated form once."""
    pack, seen = zstandard.ZstdCompressor(3), set()
    for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
        out = {}
        for text in b["text"].to_pylist():
            form = canonical(text or "").encode()
            out[hashlib.sha256(form).digest()] = form
        new = [f for wide, f in out.items() if wide not in seen]
        if len(seen) > 500_000:
            seen.clear()
        seen.update(out)
        if new:
            yield pa.RecordBatch.from_arrays([pa.array([digest(f) for f in new], pa.binary()), pa.array([pack.compress(f) for f in new], pa.binary())], ["h", "form"])


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, h, text): documents cut into ranges of descending doc_id.

    Each range also holds, as a ghost, the document that follows its last one; the document
    after the very last is the first. Splitters and first rows of ranges come to the driver:
    at most MAX_BUCKETS of each, whatever the input.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    size = int(rows.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0)
    n = min(MAX_BUCKETS, max(MIN_BUCKETS, size // BUCKET_BYTES))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).collect()[0][0] or []
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(interval(F.col("doc_id"), sorted(set(cuts))))
    rows = rows.withColumn("bucket", at)
    first = {r.bucket: (r.top.doc_id, r.top.h) for r in rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()}
    order = sorted(first, reverse=True)
    if not order:
        return rows.select("bucket", F.lit(False).alias("ghost"), "doc_id", "h", "text")
    after = {b: first[order[(i + 1) % len(order)]] for i, b in enumerate(order)}
    tops = docs.sparkSession.createDataFrame([(d, h, b) for b, (d, h) in after.items()], "doc_id long, h long, b int")
    ghosts = rows.join(F.broadcast(tops), rows.doc_id.eqNullSafe(tops.doc_id) & (rows.h == tops.h)).select(tops.b.alias("bucket"), F.lit(True).alias("ghost"), rows.doc_id, rows.h, "text")
    return rows.select("bucket", F.lit(False).alias("ghost"), "doc_id", "h", "text").unionAll(ghosts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and both likenesses.

    Texts travel once, compressed, to their range of the order, whose results are written
    down before canonical forms travel to their buckets of equal hashes. There a minimum and a
    maximum compare the bytes; both shrink before the shuffle, so a hot group of copies costs
    each task one row. The documents make the buckets; an edited text is looked up in them,
    and its likenesses to its own and the next document are comparisons of bytes.
    """
    packed = in_order(docs).mapInArrow(_compress, "bucket int, ghost boolean, doc_id long, h long, z binary")
    ordered = packed.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc("h"))
    out = cut(ordered.mapInArrow(_pairs, ROWS), "fingerprints")
    release(docs.sparkSession)
    clash = clashing(docs.select("text").mapInArrow(_forms, "h binary, form binary"))
    text = lambda c: F.lower(F.hex(c))
    for h, wide, name in (("h", "wide", "fingerprint"), ("eh", "edited_wide", "edited_fingerprint")):
        out = out.join(clash.select(F.col("h").alias("clash")), F.col(h) == F.col("clash"), "left")
        out = out.withColumn(name, F.concat_ws(":", text(h), F.when(F.col("clash").isNotNull(), text(wide)))).drop("clash")
    return out.select("doc_id", "n_chars", text("edited_sha256").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def clashing(forms: DataFrame) -> DataFrame:
    """The hashes h under which different byte strings ``form`` meet."""
    return forms.groupBy("h").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low != high").select("h")


def exact_groups(fingerprinted: DataFrame) -> DataFrame:
    """(fingerprint, n_docs, keeper): the groups of equal fingerprints and their smallest doc_id."""
    return fingerprinted.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
