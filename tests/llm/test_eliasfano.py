from __future__ import annotations

import numpy as np
import pytest

from weft.llm.eliasfano import Monotone, Trie, pack, unpack


@pytest.mark.parametrize("seed", range(30))
def test_monotone(seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(1, 600))
    bound = int(g.choice([n + 1, 5 * n + 3, 2**20, 2**40, 3]))
    v = np.sort(g.integers(0, bound, n)).astype(np.uint64)
    ef = Monotone.of(v, bound)
    assert (ef.access(np.arange(n)) == v).all()
    x = np.concatenate([v, g.integers(0, bound, 300).astype(np.uint64), [0, bound - 1]]).astype(np.uint64)
    assert (ef.successor(x) == np.searchsorted(v, x)).all()
    begin = g.integers(0, n, len(x))
    end = begin + g.integers(0, n, len(x)) % (n - begin + 1)
    want = [b + np.searchsorted(v[b:e], k) for b, e, k in zip(begin, end, x, strict=True)]
    assert (ef.successor(x, begin, end) == want).all()


@pytest.mark.parametrize("width", [1, 7, 31, 33, 63])
def test_pack(width):
    v = np.random.default_rng(width).integers(0, 2**width, 300).astype(np.uint64)
    assert (unpack(pack(v, width), width, np.arange(300)) == v).all()


def test_trie_is_a_table():
    g = np.random.default_rng(2)
    pairs = np.unique(g.integers(0, 90, (700, 2)) ** 3, axis=0)
    heads = np.unique(pairs[:, 0])
    log_p, off = -g.random(len(pairs)) * 9, -g.random(len(heads))
    trie = Trie(pairs[:, 0], pairs[:, 1], log_p, heads, off)
    table = {tuple(k): x for k, x in zip(pairs.tolist(), log_p, strict=True)}
    backoff = dict(zip(heads.tolist(), off, strict=True))
    ask = np.concatenate([pairs, g.integers(0, 95, (900, 2)) ** 3])
    lower = -g.random(len(ask)) * 5
    want = [table.get((c, w), x + backoff.get(c, 0.0)) for (c, w), x in zip(ask.tolist(), lower, strict=True)]
    assert np.abs(trie.logs(ask[:, 0], ask[:, 1], lower) - want).max() < 4e-4
    assert trie.bytes < 16 * len(pairs)
