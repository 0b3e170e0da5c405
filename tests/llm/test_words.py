from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import words
from weft.llm.shared import LOWER


def texts(seed, n=80):
    r = random.Random(seed)
    letters = "aAbBzZ\t\n \r\x0b\x0c\x1c\x85 éÉ中\U0001f600"
    return [None if k % 11 == 3 else "".join(r.choice(letters) for _ in range(r.randint(0, 60))) + ("q" * r.choice([0, 0, 63, 64, 65, 300])) for k in range(n)]


@pytest.mark.parametrize("run", [70, 1000, words.RUN])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_equal_words_have_equal_hashes(monkeypatch, run, kind):
    monkeypatch.setattr(words, "RUN", run)
    rows = texts(run)
    column = pa.array(["x y", *rows], kind).slice(1)
    h, first = words.word_hashes(column)
    want = [(t or "").encode().translate(LOWER).split() for t in rows]
    assert np.diff(first).tolist() == [len(w) for w in want]
    by = {}
    for x, w in zip(h.tolist(), [x for w in want for x in w], strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by) > 100


def test_nothing():
    for column in (pa.array([], pa.string()), pa.array([None, "", " \n"], pa.string()), pa.nulls(2, pa.string())):
        h, first = words.word_hashes(column)
        assert len(h) == 0 and first.tolist() == [0] * (len(column) + 1)


def test_no_collisions_among_many():
    w = sorted({f"{a}{b}" for a in ("", "x", "ab", "ba") for b in range(200_000)})
    h, _ = words.word_hashes(pa.array([" ".join(w)], pa.string()))
    assert len(np.unique(h)) == len(w)
