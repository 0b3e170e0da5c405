"""Elias-Fano sequences and a level of an n-gram trie of them, in one memory-mapped file.

A monotone sequence keeps the low bits of its values side by side and the high bits in unary.
All searches take arrays and answer them together.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

U = np.uint64
ONE = U(1)
#: Values that are packed, and words that are looked up, at a time.
PIECE = 1 << 18


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, in 64-bit words with one word to spare."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, dtype=U)
    if width and len(values):
        for k in range(0, len(values), PIECE):
            some = values[k : k + PIECE]
            at = np.arange(k, k + len(some), dtype=U) * U(width)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(out, word, some << shift)
            over = shift + U(width) > U(64)
            np.bitwise_or.at(out, word[over] + 1, some[over] >> (U(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at places ``at`` of a packed array."""
    if not width:
        return np.zeros(len(at), dtype=U)
    bit = at.astype(U) * U(width)
    word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return ((words[word] >> shift) | high) & U((1 << width) - 1)


def nth_one(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit (from 0) of each word."""
    place, n = np.zeros(len(words), dtype=U), n.astype(U)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((words >> place) & U((1 << half) - 1)).astype(U)
        beyond = n >= low
        n = np.where(beyond, n - low, n)
        place = np.where(beyond, place + U(half), place)
    return place


class Monotone:
    """A non-decreasing sequence of integers below ``bound``; its arrays may be views of a file."""

    def __init__(self, arrays: dict[str, np.ndarray], size: int, width: int):
        self.arrays, self.size, self.width = arrays, size, width

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> Monotone:
        n = len(values)
        width = max(0, (bound // max(1, n)).bit_length() - 1)
        values = values.astype(U)
        high = (values >> U(width)).astype(np.int64)
        bits = n + (bound >> width) + 2
        at = high + np.arange(n)
        upper = np.packbits(np.bincount(at, minlength=(bits + 63) // 64 * 64).astype(np.uint8), bitorder="little").view(U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
        return cls({"low": pack(values & U((1 << width) - 1), width), "upper": upper, "ones": ones.astype(np.uint32 if n < 2**32 else np.int64)}, n, width)

    def _zeros_before(self) -> np.ndarray:
        return np.arange(len(self.arrays["ones"]), dtype=np.int64) * 64 - self.arrays["ones"].astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at places."""
        ones = self.arrays["ones"]
        word = np.searchsorted(ones, at, "right") - 1
        place = nth_one(self.arrays["upper"][word], at - ones[word].astype(np.int64))
        high = word * 64 + place.astype(np.int64) - at
        return (high.astype(U) << U(self.width)) | unpack(self.arrays["low"], self.width, at)

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The first place in [begin, end) whose value is at least x; end where there is none."""
        end = np.broadcast_to(self.size if end is None else end, x.shape)
        begin = np.broadcast_to(begin, x.shape)
        h, low = (x >> U(self.width)).astype(np.int64), x & U((1 << self.width) - 1)
        zeros = self._zeros_before()
        # elements whose high bits are below h, and below h + 1: what stands before the h-th zero from 1
        def below(k: np.ndarray) -> np.ndarray:
            k = np.minimum(k, zeros[-1])
            word = np.searchsorted(zeros, k - 1, "right") - 1
            word = np.clip(word, 0, len(self.arrays["upper"]) - 1)
            place = nth_one(~self.arrays["upper"][word], np.maximum(k - 1, 0) - zeros[word])
            return np.where(k > 0, np.minimum(word * 64 + place.astype(np.int64) - (k - 1), self.size), 0)

        at, stop = np.maximum(below(h), begin), np.minimum(below(h + 1), end)
        at = np.minimum(at, end)
        # between at and stop high bits are those of x, and low bits ascend: by halves, as such a range may hold very many
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            half = (at[open_] + stop[open_]) >> 1
            less = unpack(self.arrays["low"], self.width, half) < low[open_]
            at[open_[less]], stop[open_[~less]] = half[less] + 1, half[~less]
            open_ = open_[at[open_] < stop[open_]]
        return at


def quantise(logs: np.ndarray, lowest: float) -> np.ndarray:
    """Logarithms in [lowest, 0] as 16-bit codes."""
    return np.clip(np.rint(logs / lowest * 65535), 0, 65535).astype(np.uint16)


class Trie:
    """One order's level of an n-gram trie: contexts, their words and the quantised probabilities, memory-mapped.

    A context is named by the number of its n-gram on the level above. Level one: the contexts, ascending, each with a pointer to its words and a back-off
    weight. Level two: all words, each raised by what the ranges before its own reach, so
    that the level is one monotone sequence; a word is found by a successor search relative
    to its context's base, inside the context's range.
    """

    LOWEST = -24.0

    def __init__(self, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, heads: np.ndarray, log_backoff: np.ndarray, folder: str | None = None):
        """context, word: sorted distinct pairs; heads: the distinct contexts, with their back-off weights."""
        first = np.searchsorted(context, heads)
        bound = np.concatenate([first, [len(context)]])
        most = np.zeros(len(heads), dtype=U)
        some = np.diff(bound) > 0
        most[some] = word[bound[1:][some] - 1].astype(U) + ONE
        base = np.concatenate([[U(0)], np.cumsum(most, dtype=U)])
        raised = word.astype(U) + np.repeat(base[:-1], np.diff(bound))
        self.heads = Monotone.of(heads, int(heads[-1]) + 1 if len(heads) else 1)
        self.pointers = Monotone.of(bound, len(context) + 1)
        self.bases = Monotone.of(base, int(base[-1]) + 1)
        self.words = Monotone.of(raised, int(base[-1]) + 1)
        self.p, self.backoff = quantise(log_p, self.LOWEST), quantise(log_backoff, self.LOWEST)
        self.n_heads = len(heads)
        self._map(folder)

    def _map(self, folder: str | None) -> None:
        parts = {f"{level}.{k}": a for level in ("heads", "pointers", "bases", "words") for k, a in getattr(self, level).arrays.items()} | {"p": self.p, "backoff": self.backoff}
        fd, self.path = tempfile.mkstemp(dir=folder, suffix=".trie")
        places, at = {}, 0
        with os.fdopen(fd, "wb") as f:
            for k, a in parts.items():
                f.write(b"\0" * (-at % 8))
                at += -at % 8
                places[k] = (at, a.dtype, len(a))
                f.write(a.tobytes())
                at += a.nbytes
        whole = np.memmap(self.path, dtype=np.uint8, mode="r") if at else np.empty(0, np.uint8)
        self.bytes = at
        view = lambda k: whole[places[k][0] : places[k][0] + places[k][2] * places[k][1].itemsize].view(places[k][1])
        for level in ("heads", "pointers", "bases", "words"):
            own = getattr(self, level)
            own.arrays = {k: view(f"{level}.{k}") for k in own.arrays}
        self.p, self.backoff = view("p"), view("backoff")
        os.unlink(self.path)  # the mapping keeps it until the trie is gone

    def _nodes(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of contexts on level one, and whether they are there."""
        node = self.heads.successor(contexts.astype(U))
        known = node < self.n_heads
        safe = np.where(known, node, 0)
        return safe, known & (self.heads.access(safe) == contexts)

    def logs(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 of each word's probability after its context; ``lower``: that of the word alone."""
        if not self.n_heads:
            return lower
        out = np.empty(len(word))
        for k in range(0, len(word), PIECE):
            own = slice(k, k + PIECE)
            out[own] = self._logs(context[own], word[own], lower[own])
        return out

    def _logs(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not self.words.size:
            safe, known = self._nodes(context)
            return lower + np.where(known, self.backoff[safe] * (self.LOWEST / 65535), 0.0)
        distinct, which = np.unique(context, return_inverse=True)
        safe, known = self._nodes(distinct)
        begin, end = (self.pointers.access(safe + k).astype(np.int64) for k in (0, 1))
        base = self.bases.access(safe)
        seek = word.astype(U) + base[which]
        place = self.words.successor(seek, begin[which], end[which])
        inside = known[which] & (place < end[which])
        at = np.where(inside, place, 0)
        inside &= self.words.access(at) == seek
        step = self.LOWEST / 65535
        backed = lower + np.where(known[which], self.backoff[safe][which] * step, 0.0)
        return np.where(inside, self.p[at] * step, backed)
