"""BPE encoding and decoding with a public tokenizer file, by tree concatenation.

A text breaks exactly at ASCII white space, so its runs between white space are encoded
one by one, each distinct run once while it stays in a task's cache. A run too long for a
leaf is first brought to what the model sees: control tokens are taken out, what lies between
them is normalised as a whole (marks are put in order and composed over any distance) and
split into pieces, which the model encodes independently of each other. A piece too long for
a leaf is halved; the halves are encoded, and a window around the join is re-encoded, and
grown, until on both sides a few tokens (ids and places) are those of the halves. Any two
neighbours of the result are then neighbours of some true encoding of the piece's characters
by merges alone, which makes the whole the encoding of the whole. Texts longer than a part
are cut into parts that different tasks encode: at white space, or, where a run fills a
part, between and inside its pieces; where a piece is cut, the same join mends it.

Nulls: a null text is the empty text, which has no tokens. Rows that are wholly equal give
equal rows. Other columns than doc_id and text are not looked at, whatever their names. One
task holds the whole of a text when it is cut, and the whole of its encoding when the parts
meet. The tokenizer must drop white space and know no token that contains any, and its control
tokens must be matched as written; others are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import singly, small_batches, trimmed

#: Characters of a run that are encoded at once, and of a text that one task encodes.
LEAF, PART = 4096, 32_768
#: Distinct runs that a task remembers, of so many bytes at most: together under 100 MB.
CACHE, LONGEST = 160_000, 64
AGREE = 3
#: Characters that are split into pieces at a time, and pieces at their end that may yet go on.
CHUNK, UNSURE = 1 << 16, 4
#: The character that stands for control token 0 among a run's pieces; byte-level names lie below.
CONTROL = 0xF0000
SPACE = " \t\n\r\x0b\x0c"

Token = tuple[int, int, int]  # id, first and last character


@lru_cache(2)
def tokenizer(path: str):
    """The tokenizer of a file, once per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Leaf:
    """A tokenizer's steps one by one: the pieces of a text, and the tokens of a piece."""

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(tokenizer(path).to_str())
        odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or CONTROL + t["id"] > 0x10FFFF]
        if odd:
            raise ValueError(f"control tokens that depend on what stands around them: {odd}")
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.controls = re.compile("|".join(map(re.escape, sorted(self.control, key=len, reverse=True))) or r"(?!)")

    def __call__(self, text: str) -> list[Token]:
        """The library's tokens of a text, with places in it."""
        e = tokenizer(self.path).encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def pieces(self, text: str) -> Iterator[str]:
        """What the model encodes, in order; a control token is one character from CONTROL on."""
        at = 0
        for m in self.controls.finditer(text):
            yield from self._split(text[at : m.start()])
            yield chr(CONTROL + self.control[m[0]])
            at = m.end()
        yield from self._split(text[at:])

    def _split(self, text: str) -> Iterator[str]:
        t = tokenizer(self.path)
        if t.normalizer:
            text = t.normalizer.normalize_str(text)
        at, size = 0, CHUNK
        while at < len(text):
            found = t.pre_tokenizer.pre_tokenize_str(text[at : at + size])
            if at + size >= len(text):
                yield from (p for p, _ in found)
                return
            if len(found) <= UNSURE:
                size *= 2
                continue
            yield from (p for p, _ in found[:-UNSURE])
            at, size = at + found[-UNSURE][1][0], CHUNK

    def piece(self, text: str) -> list[Token]:
        """The model's tokens of a piece, or of some characters in a row of one."""
        if CONTROL <= ord(text[0]):
            return [(ord(text) - CONTROL, 0, 1)]
        out, at = [], 0
        tokens = tokenizer(self.path).model.tokenize(text)
        for k, t in enumerate(tokens):
            n = len(t.value) - (len(self.suffix) if k == len(tokens) - 1 else 0)
            out.append((t.id, at, at + n))
            at += n
        return out


@lru_cache(2)
def leaf(path: str) -> Leaf:
    return Leaf(path)


def _common(a: list[Token], b: list[Token], last: bool) -> tuple[int, int] | None:
    """Where AGREE equal tokens in a row stand in a and b: the first such place, or the last."""
    at = {tuple(b[k : k + AGREE]): k for k in range(len(b) - AGREE + 1)}
    places = range(len(a) - AGREE + 1)
    for k in reversed(places) if last else places:
        if (j := at.get(tuple(a[k : k + AGREE]))) is not None:
            return k, j
    return None


def join(encode: Callable[[str], list[Token]], left: str, a: list[Token], right: str, b: list[Token]) -> list[Token]:
    """The tokens of left + right from those of left and of right."""
    shift, k = len(left), 48
    while True:
        start, end = max(0, len(left) - k), min(len(right), k)
        if start == 0 and end == len(right):
            return encode(left + right)
        window = [(i, x + start, y + start) for i, x, y in encode(left[start:] + right[:end])]
        near_a = next((n for n in range(len(a) - 1, -1, -1) if a[n][1] < start), -1) + 1
        near_b = next((n for n in range(len(b)) if b[n][2] > end), len(b))
        moved = [(i, x + shift, y + shift) for i, x, y in b[:near_b]]
        ahead = (0, 0) if start == 0 else _common(window, a[near_a:], last=False)
        behind = (len(window) - AGREE, near_b - AGREE) if end == len(right) else _common(window, moved, last=True)
        if ahead and behind and ahead[0] + AGREE <= behind[0] + AGREE and (start == 0 or window[ahead[0] + AGREE - 1][2] <= shift) and (end == len(right) or window[behind[0]][1] >= shift):
            keep_left = 0 if start == 0 else near_a + ahead[1]
            stop, keep_right = (len(window), len(b)) if end == len(right) else (behind[0], behind[1])
            return a[:keep_left] + window[ahead[0] : stop] + [(i, x + shift, y + shift) for i, x, y in b[keep_right:]]
        k *= 2


def halves(encode: Callable[[str], list[Token]], piece: str, size: int = LEAF) -> list[Token]:
    """The tokens of an unsplit piece by halves."""
    if len(piece) <= size:
        return encode(piece)
    half = len(piece) // 2
    left, right = piece[:half], piece[half:]
    return join(encode, left, halves(encode, left, size), right, halves(encode, right, size))


def tree(encode: Leaf, text: str, size: int = LEAF) -> list[Token]:
    """The tokens of a text, its long pieces by halves; places count through the pieces."""
    out, at = [], 0
    for p in encode.pieces(text):
        out += [(i, a + at, b + at) for i, a, b in halves(encode.piece, p, size)]
        at += len(p)
    return out


#: Runs of these characters alone are split here, as the tokenizer's pattern does; NFC leaves them as they are.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PLAIN = re.compile(r"[!-~¡-ÿ]+\Z")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


def byte_names() -> dict[int, str]:
    """The characters by which byte-level models name bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(256 + k) for k, x in enumerate(rest)}


class Runs:
    """Encodes texts run by run; the cache holds each run's ids as text, their number and its decoding."""

    def __init__(self, path: str):
        self.path, self.encode, self.names = path, leaf(path), byte_names()
        self.forget()
        t = json.loads(tokenizer(path).to_str())
        #: whether runs of plain characters may be split here; a file of another kind is left to the library
        kinds = [x["type"] for x in (t["normalizer"] or {}).get("normalizers", [])]
        split = (t["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.tokens = {i: w for w, i in tokenizer(path).get_vocab(with_added_tokens=True).items()} if t["decoder"] is None else None

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            return tokenizer(self.path).decode(ids, skip_special_tokens=False)
        return " ".join([self.tokens[i] for i in ids])

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            named = "".join([self.names[x] for x in text.encode()])
            ids = [t.id for t in tokenizer(self.path).model.tokenize(named)]
            if len(text) <= LONGEST:
                self.pieces[text] = ids
        return ids

    def forget(self) -> None:
        self.known, self.pieces, self.large = {}, {}, []

    def learn(self, runs: list[bytes]) -> None:
        new = list({r for r in runs if r not in self.known})
        if len(self.known) + len(new) > CACHE or len(self.pieces) > CACHE:
            self.forget()
            new = list(set(runs))
        texts = [r.decode() for r in new]
        ids: dict[str, list[int]] = {}
        for r in texts:
            if len(r) > LEAF:
                ids[r] = [i for i, _, _ in tree(self.encode, r)]
            elif self.plain and _PLAIN.match(r) and "<|" not in r:
                ids[r] = [i for p in _PIECES.findall(r.lower()) for i in self.piece(p)]
        rest = [r for r in texts if r not in ids]
        ids.update((r, e.ids) for r, e in zip(rest, tokenizer(self.path).encode_batch_fast(rest, add_special_tokens=False), strict=True))
        for r, text in zip(new, texts, strict=True):
            own = ids[text]
            self.known[r] = (" ".join(map(str, own)), len(own), self.decode(own))
        self.large += [r for r in new if len(r) > LONGEST]

    def text(self, text: str) -> tuple[str, int, str]:
        """The ids as decimal text, their number, and the decoding."""
        runs = text.encode().split()
        try:
            found = [self.known[r] for r in runs]
        except KeyError:
            self.learn(runs)
            found = [self.known[r] for r in runs]
            for r in self.large:  # long runs are known for one text only
                del self.known[r]
            self.large.clear()
        found = [x for x in found if x[1]]
        return " ".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])


@lru_cache(2)
def runs_of(path: str) -> Runs:
    """One cache for all tasks that a worker process runs."""
    return Runs(path)


#: What becomes of a document's (ids as text, number, decoding).
Finish = tuple[str, Callable[[str, int, str], tuple]]


def _whole(ids: str, n: int, decoded: str) -> tuple:
    return n, [int(x) for x in ids.split()], decoded


def _digests(ids: str, n: int, decoded: str) -> tuple:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _tokens(ids: str, n: int, decoded: str) -> tuple:
    return n, [int(x) for x in ids.split()], hashlib.sha256(decoded.encode()).hexdigest()


WHOLE: Finish = ("n_tokens long, ids array<int>, decoded string", _whole)
DIGESTS: Finish = ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
TOKENS: Finish = ("n_tokens long, ids array<int>, decoded_sha256 string", _tokens)
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _short(path: str, finish: Finish):
    @trimmed(lambda: runs_of(path).forget())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = runs_of(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part["text"].to_pylist()]
                ids = zip(part["doc_id"].to_pylist(), part["tag"].to_pylist(), texts, strict=True)
                yield _batch(f"doc_id long, tag long, {finish[0]}", [(i, tag, *finish[1](*runs.text(t))) for i, tag, t in ids])

    return run


PARTS = "doc_id long, tag long, key long, copies long, part int, pieces boolean, hard boolean, open boolean, text string"


def parts(text: str, size: int = PART) -> list[tuple[bool, bool, str]]:
    """A text in parts of at most ``size`` characters: (whether it begins, and ends, inside a run; text)."""
    out, at, hard = [], 0, False
    while len(text) - at > size:
        gap = max(text.rfind(c, at + 1, at + size) for c in SPACE)
        end = at + size if gap < 0 else gap
        out.append((hard, gap < 0, text[at:end]))
        at, hard = end, gap < 0
    return [*out, (hard, False, text[at:])]


def divided(encode: Leaf, text: str, size: int = PART) -> Iterator[tuple[bool, bool, bool, str]]:
    """The parts of a text: (whether it is pieces with blanks between, begins and ends inside a piece; text)."""
    at = 0
    for m in re.finditer(rf"[^{SPACE}]{{{max(1, size - 1)},}}", text):  # such a run might fill a part
        if m.start() > at:
            yield from ((False, *p) for p in parts(text[at : m.start()], size))
        yield from ((True, *p) for p in parts(" ".join(encode.pieces(m[0])), size))
        at = m.end()
    if at < len(text):
        yield from ((False, *p) for p in parts(text[at:], size))


def _cut(path: str, size: int):
    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in singly(batches):
            for n, p in enumerate(divided(leaf(path), row["text"], size)):
                yield _batch(PARTS, [(*(row[c] for c in ("doc_id", "tag", "key", "copies")), n, *p)])

    return run


#: A part's encoding: its first run if that goes on from the part before, the runs between, its last run if that goes on.
ENCODED = "doc_id long, tag long, key long, copies long, part int, hard boolean, open boolean, head string, head_tokens binary, ids string, decoded string, n long, tail string, tail_tokens binary"
_EDGE = re.compile(rf"[^{SPACE}]+")


def _encode_parts(path: str):
    def packed(text: str) -> bytes:
        return np.array(halves(leaf(path).piece, text) if text else [], dtype=np.int32).tobytes()

    @trimmed(lambda: runs_of(path).forget())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = runs_of(path)
        for row in singly(batches):
            text, head, tail = row["text"], "", ""
            if row["hard"] and (m := _EDGE.match(text)):
                head, text = m[0], text[m.end() :]
            if row["open"]:
                at = max(text.rfind(c) for c in SPACE) + 1
                tail, text = text[at:], text[:at]
            if row["pieces"]:
                own = [i for p in _EDGE.findall(text) for i, _, _ in halves(leaf(path).piece, p)]
                ids, n, decoded = " ".join(map(str, own)), len(own), runs.decode(own)
            else:
                ids, n, decoded = runs.text(text)
            yield _batch(ENCODED, [(*(row[c] for c in ("doc_id", "tag", "key", "copies", "part", "hard", "open")), head, packed(head), ids, decoded, n, tail, packed(tail))])

    return run


def _concat(encode, pieces: list[tuple[str, list[Token]]]) -> list[Token]:
    """The tokens of a piece from its parts', joined as a tree."""
    while len(pieces) > 1:
        paired = [(l + r, join(encode, l, a, r, b)) for (l, a), (r, b) in zip(pieces[::2], pieces[1::2], strict=False)]
        pieces = paired + pieces[len(paired) * 2 :]
    return pieces[0][1] if pieces else []


def _join_parts(path: str, finish: Finish):
    def unpacked(text: str, blob: bytes) -> tuple[str, list[Token]]:
        return text, [tuple(t) for t in np.frombuffer(blob, np.int32).reshape(-1, 3).tolist()]

    def done(rows: list[dict]) -> pa.RecordBatch:
        found: list[tuple[str, int, str]] = []
        held: list[tuple[str, list[Token]]] = []
        for row in rows:
            through = row["hard"] and row["open"] and not row["n"] and not row["tail"]
            if row["hard"]:
                held.append(unpacked(row["head"], row["head_tokens"]))
            if not through:
                own = [i for i, _, _ in _concat(leaf(path).piece, held)]
                found += [(" ".join(map(str, own)), len(own), runs_of(path).decode(own)), (row["ids"], row["n"], row["decoded"])]
                held = [unpacked(row["tail"], row["tail_tokens"])] if row["open"] else []
        found = [x for x in found if x[1]]
        row = finish[1](" ".join([x[0] for x in found]), sum(x[1] for x in found), " ".join([x[2] for x in found]))
        return _batch(f"doc_id long, tag long, copies long, {finish[0]}", [(rows[0]["doc_id"], rows[0]["tag"], rows[0]["copies"], *row)])

    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in singly(batches):
            if rows and any(rows[0][c] != row[c] for c in ("key", "doc_id", "tag")):
                yield done(rows)
                rows = []
            rows.append(row)
        if rows:
            yield done(rows)

    return run


def encode(docs: DataFrame, path: str, finish: Finish = WHOLE, part: int = PART, tag: Column | None = None) -> DataFrame:
    """One row per document: doc_id, ``tag`` if given, and what ``finish`` makes of its encoding and decoding.

    Texts of up to ``part`` characters stay in their partition. Longer ones travel twice, in
    parts: to the tasks that encode them, and to the task that joins a document's parts. A tag
    is a whole number that stays with its document.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(None) if tag is None else tag).cast("long").alias("tag"), "text")
    result = f"doc_id long, tag long, {finish[0]}"
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= part).mapInArrow(_short(path, finish), result)
    long = rows.where(F.length("text") > part).groupBy("doc_id", "tag", "text").agg(F.count(F.lit(1)).alias("copies"))
    cut = long.select("doc_id", "tag", F.xxhash64("doc_id", "tag", "text").alias("key"), "copies", "text").mapInArrow(_cut(path, part), PARTS)
    spread = cut.repartition("key", "part").mapInArrow(_encode_parts(path), ENCODED)
    joined = spread.repartition("key").sortWithinPartitions("key", "doc_id", "tag", "part").mapInArrow(_join_parts(path, finish), result.replace("tag long", "tag long, copies long"))
    again = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    out = short.unionByName(again)
    return out.drop("tag") if tag is None else out
