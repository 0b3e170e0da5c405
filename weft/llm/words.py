"""Hashes of all words of a batch of texts at once.

A word is a run without ASCII white space, A-Z in lower case. Its hash is a polynomial in an
odd number modulo 2**64 over random values of its bytes, from prefix sums of the batch's
bytes, and then mixed; words beyond LONG bytes, where such polynomials have known collisions,
are hashed by xxh64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from weft.llm.shared import LOWER

#: Bytes whose prefix sums are made at a time, and of a word at most.
RUN, LONG = 1 << 17, 64
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * (n - 1), dtype=np.uint64))


_VALUE = np.random.default_rng(20_260_101).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER, _BACK = (_powers(b, RUN + LONG + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in lower case, one after another, and where each begins (and the last ends); null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return _LOWER[raw], at - at[0]


def word_places(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in flat texts, and the number of each text's first word (and of all)."""
    gap = _GAP[low]
    edge = np.empty(len(low) + 1, dtype=bool)  # a place before which no word goes on
    edge[0] = edge[-1] = True
    edge[1:-1] = gap[:-1] != gap[1:]
    edge[at] = True
    places = np.flatnonzero(edge)
    begin, end = places[:-1], places[1:]
    solid = ~gap[begin] if len(low) else np.zeros(0, dtype=bool)
    begin, end = begin[solid], end[solid]
    return begin, end, np.searchsorted(begin, at)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and the number of each text's first word (and of all)."""
    low, at = flat(texts)
    begin, end, first = word_places(low, at)
    out = np.empty(len(begin), dtype=np.uint64)
    long = np.flatnonzero(end - begin > LONG)
    some = np.flatnonzero(end - begin <= LONG) if len(long) else np.arange(len(begin))
    b, e, k = begin[some], end[some], 0
    while k < len(some):
        j = int(np.searchsorted(b, b[k] + RUN))
        own = low[b[k] : e[j - 1]]
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[own] * _POWER[: len(own)], out=sums[1:])
        x, y = b[k:j] - b[k], e[k:j] - b[k]
        out[some[k:j]] = (sums[y] - sums[x]) * _BACK[x]
        k = j
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(low[begin[i] : end[i]].tobytes())
    return mixed(out), first
