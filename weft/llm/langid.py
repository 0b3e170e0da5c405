"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: every byte of a
training window is labelled with its document's language. Prediction labels every byte of a
text, window by window, and pools the probabilities of all positions; the language is the
largest, its pooled probability the score.

Training takes at most PER_LANGUAGE documents of each language, a snippet of each, from the
documents that the caller allows. A text that is null or has no letter is ``und`` with score
0, and so is every text where no document was labelled. Rows are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import named, small_batches, trimmed

#: The bound on training: documents of a language, and characters of each.
PER_LANGUAGE, SNIPPET = 400, 320
HIDDEN, STEPS, BATCH, SPAN, RATE = 8, 260, 64, 80, 0.02
#: Bytes of a window when predicting, and windows at a time.
WINDOW, TOGETHER = 256, 2048
UNKNOWN = "und"


@dataclass
class Direction:
    """One gated recurrent layer: gates z, r and the candidate, side by side."""

    x: np.ndarray  # 256 x 3H: a byte's contribution, bias included
    u: np.ndarray  # H x 3H
    b: np.ndarray  # H: bias of the candidate's recurrent part

    def step(self, byte: np.ndarray, h: np.ndarray):
        hid = h.shape[1]
        g, v = self.x[byte], h @ self.u
        zr = 1 / (1 + np.exp(-(g[:, : 2 * hid] + v[:, : 2 * hid])))
        z, r = zr[:, :hid], zr[:, hid:]
        w = v[:, 2 * hid :] + self.b
        n = np.tanh(g[:, 2 * hid :] + r * w)
        return n + z * (h - n), (z, r, w, n)


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # 2H x C
    bias: np.ndarray

    def pooled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities, windows x languages. data: steps x windows."""
        hid, (steps, n) = self.out.shape[0] // 2, data.shape
        states = np.zeros((steps + 1, n, hid), dtype=np.float32)
        for t in range(steps):
            states[t + 1], _ = self.ahead.step(data[t], states[t])
        total, h, shortest = np.zeros((n, len(self.bias)), dtype=np.float32), np.zeros((n, hid), dtype=np.float32), int(lengths.min())
        for t in reversed(range(steps)):
            h, _ = self.back.step(data[t], h)
            if t >= shortest:  # some windows have ended: theirs is not a position, nor a state
                h *= (t < lengths)[:, None]
            p = np.exp(states[t + 1] @ self.out[:hid] + h @ self.out[hid:] + self.bias)
            p /= p.sum(axis=1, keepdims=True)
            total += p * (t < lengths)[:, None] if t >= shortest else p
        return total


def train(snippets: list[bytes], languages: list[str], seed: int = 1) -> Network:
    """Adam on the mean cross-entropy of all positions of random windows, languages in equal parts."""
    names = sorted(set(languages))
    g = np.random.default_rng(seed)
    c, hid = len(names), HIDDEN
    shapes = {"ax": (256, 3 * hid), "au": (hid, 3 * hid), "ab": (hid,), "bx": (256, 3 * hid), "bu": (hid, 3 * hid), "bb": (hid,), "o": (2 * hid, c), "ob": (c,)}
    p = {k: (g.standard_normal(s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for k, s in shapes.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    groups = [[s for s, name in zip(snippets, languages, strict=True) if name == want and s] for want in names]
    for step in range(1, STEPS + 1 if c > 1 else 1):
        label = np.arange(BATCH) % c
        data = np.full((SPAN, BATCH), 32, dtype=np.uint8)
        for k, y in enumerate(label):
            s = groups[y][g.integers(len(groups[y]))]
            at = int(g.integers(max(1, len(s) - SPAN + 1)))
            own = np.frombuffer(s[at : at + SPAN], dtype=np.uint8)
            data[: len(own), k] = own
        grads = _gradients(p, data, label)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, d in grads.items():
            d = np.clip(d, -1, 1)
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return Network(names, Direction(p["ax"], p["au"], p["ab"]), Direction(p["bx"], p["bu"], p["bb"]), p["o"], p["ob"])


def loss(p: dict[str, np.ndarray], data: np.ndarray, label: np.ndarray) -> float:
    """Mean cross-entropy of all positions, for checking the gradients."""
    steps, n = data.shape
    hid = p["o"].shape[0] // 2
    runs = {}
    for side, order in (("a", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((n, hid), dtype=p["o"].dtype)
        for t in order:
            h, _ = Direction(p[side + "x"], p[side + "u"], p[side + "b"]).step(data[t], h)
            runs[side, t] = h
    total = 0.0
    for t in range(steps):
        s = runs["a", t] @ p["o"][:hid] + runs["b", t] @ p["o"][hid:] + p["ob"]
        total += float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(n), label]).sum())
    return total / (steps * n)


def _gradients(p: dict[str, np.ndarray], data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time, through both directions."""
    steps, n = data.shape
    hid = p["o"].shape[0] // 2
    grads = {k: np.zeros_like(x) for k, x in p.items()}
    kept: dict[str, list] = {}
    for side in "ab":
        d, h, kept[side] = Direction(p[side + "x"], p[side + "u"], p[side + "b"]), np.zeros((n, hid), dtype=p["o"].dtype), []
        for t in range(steps) if side == "a" else reversed(range(steps)):
            new, parts = d.step(data[t], h)
            kept[side].append((t, h, new, parts))
            h = new
    state = {(side, t): new for side in "ab" for t, _, new, _ in kept[side]}
    above: dict[tuple[str, int], np.ndarray] = {}
    for t in range(steps):
        both = np.concatenate([state["a", t], state["b", t]], axis=1)
        s = both @ p["o"] + p["ob"]
        y = np.exp(s - s.max(axis=1, keepdims=True))
        y /= y.sum(axis=1, keepdims=True)
        y[np.arange(n), label] -= 1
        y /= steps * n
        grads["o"] += both.T @ y
        grads["ob"] += y.sum(axis=0)
        down = y @ p["o"].T
        above["a", t], above["b", t] = down[:, :hid], down[:, hid:]
    for side in "ab":
        u, carried = p[side + "u"], np.zeros((n, hid), dtype=p["o"].dtype)
        for t, h, _, (z, r, w, c) in reversed(kept[side]):
            dh = carried + above[side, t]
            dn = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dn * w * r * (1 - r)
            dw = dn * r
            dv = np.concatenate([dz, dr, dw], axis=1)
            np.add.at(grads[side + "x"], data[t], np.concatenate([dz, dr, dn], axis=1))
            grads[side + "u"] += h.T @ dv
            grads[side + "b"] += dw.sum(axis=0)
            carried = dh * z + dv @ u.T
    return grads


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text; the whole of each is read."""
    found = [any(map(str.isalpha, t or "")) for t in texts]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not net.languages:
        return names, scores
    blobs = [(k, np.frombuffer(t.encode(), dtype=np.uint8)) for k, t in enumerate(texts) if found[k]]
    if not blobs:
        return names, scores
    sums = np.zeros((len(texts), len(net.languages)))
    owner = np.concatenate([np.full(-(-len(d) // WINDOW), k) for k, d in blobs])
    pieces = [d[at : at + WINDOW] for _, d in blobs for at in range(0, len(d), WINDOW)]
    lengths = np.array([len(x) for x in pieces])
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), TOGETHER):
        take = order[at : at + TOGETHER]
        own = lengths[take]
        data = np.zeros((len(take), int(own[0])), dtype=np.uint8)
        for row, k in enumerate(take):
            data[row, : own[row]] = pieces[k]
        np.add.at(sums, owner[take], net.pooled(np.ascontiguousarray(data.T), own))
    for k, d in blobs:
        mean = sums[k] / len(d)
        best = int(mean.argmax())
        names[k], scores[k] = net.languages[best], float(min(1.0, mean[best]))
    return names, scores


def fit(docs: DataFrame, allowed: Column) -> Network:
    """A network from a bounded sample of the labelled documents that ``allowed`` lets through.

    Equal texts of a language are one. The driver receives one row per language and twice
    PER_LANGUAGE snippets or so of each, of which the PER_LANGUAGE smallest draws are taken.
    """
    rows = docs.where(allowed & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    many = {r.lang: r.n for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return Network([], None, None, None, None)
    share = F.lit(0.0)
    for name, n in many.items():
        share = F.when(F.col("lang") == name, F.lit(2 * PER_LANGUAGE / n)).otherwise(share)
    draw = F.col("h").bitwiseAND(F.lit((1 << 40) - 1))
    begin = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SNIPPET + 1)).cast("int") + 1
    snippet = F.substr("text", begin, F.lit(SNIPPET)).alias("s")
    drawn = rows.where(draw / float(1 << 40) < share).select("lang", "h", draw.alias("draw"), snippet).groupBy("lang", "h", "draw").agg(F.min("s").alias("s"))
    every = sorted((r.lang, r.draw, r.s) for r in drawn.collect())
    sample = [x for _, own in groupby(every, key=lambda x: x[0]) for x in islice(own, PER_LANGUAGE)]
    missing = [name for name in many if name not in {x[0] for x in sample}]
    for name in missing:  # so rare that the draw missed it
        sample += [(name, 0, r.s) for r in rows.where(F.col("lang") == name).select("h", snippet).dropDuplicates(["h"]).limit(PER_LANGUAGE).collect()]
    return train([s.encode() for _, _, s in sample], [name for name, _, _ in sample])


def _label(net: Network, names: list[str], results: tuple[str, str]):
    @trimmed()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            lang, score = predict(net, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, *results])

    return run


def identify(docs: DataFrame, net: Network, keep: list[str], results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` and the language and score under the names ``results``. Only the text is looked at.

    A kept column that has one of those names gives way to the result.
    """
    keep = [c for c in keep if c.lower() not in {r.lower() for r in results}]
    small_batches(docs.sparkSession)
    # plain names on the way, as mapInArrow takes no others
    plain = ["text" if c == "text" else f"c{k}" for k, c in enumerate(keep)]
    rows = docs.select(*(named(c).alias(p) for p, c in zip(plain, keep, strict=True)), *(["text"] if "text" not in keep else []))
    schema = rows.select(*plain, F.lit("").alias("lang"), F.lit(0.0).alias("score")).schema
    for f in schema.fields:
        f.nullable = True
    out = rows.mapInArrow(_label(net, plain, ("lang", "score")), schema)
    return out.select(*(F.col(p).alias(c) for p, c in zip([*plain, "lang", "score"], [*keep, *results], strict=True)))


def held_out(parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from training, by the checksum of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))
