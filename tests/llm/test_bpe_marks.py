"""Marks that are put in order and composed over any distance, across every kind of cut."""

from __future__ import annotations

import random

import pytest

from weft.llm import bpe
from weft.llm.queries import vocabulary
from tests.llm.test_bpe import whole

PATH = vocabulary()
#: Letters with marks above and below, marks alone, jamo that compose, letters whose lower case is longer, and what ends pieces.
KINDS = ["ẹ́", "̣́", "ạ̈́ẹ", "각각", "İΑΣ̇́", "ab'sl", "1a!", "a", "　b\x85"]


def runs(n: int, least: int, most: int, seed: int) -> list[str]:
    r = random.Random(seed)
    out = ["".join(r.choice(KINDS[k % len(KINDS)]) for _ in range(r.randint(least, most))) for k in range(n)]
    return [t[:40] + r.choice(["<|endoftext|>", "<|startoftext|>", "<|end"]) + t[40:] if k % 4 == 0 else t for k, t in enumerate(out)]


@pytest.mark.parametrize("size", [16, 64, bpe.LEAF])
def test_any_leaf(size):
    encode = bpe.leaf(PATH)
    for text in runs(60, 100, 900, size) + runs(9, 5000, 20000, size):
        assert [i for i, _, _ in bpe.tree(encode, text, size)] == whole(text)[0]


def test_chunks_split_as_the_whole(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 32)
    encode = bpe.leaf(PATH)
    for text in runs(60, 10, 400, 2) + ["'l" * 100 + "l", "x'" * 40 + "'ve'r", "1" * 300]:
        assert [i for i, _, _ in bpe.tree(encode, text, 64)] == whole(text)[0]


def test_cuts_between_tasks(spark):
    texts = runs(27, 50, 900, 9) + [" ".join(runs(6, 20, 300, 10 + k)) for k in range(20)] + ["́" * 500 + "̣" * 500]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, part=64)
    assert {r.doc_id: (list(r.ids), r.decoded) for r in got.collect()} == {k: whole(t) for k, t in enumerate(texts)}


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 120)
    own = bpe.Runs(PATH)
    for k in range(300):
        text = " ".join([*(f"w{k}x{j}" for j in range(40)), "long" * 40])
        assert own.text(text)[0] == " ".join(map(str, whole(text)[0]))
        assert len(own.known) <= 120 and len(own.pieces) < 1000 and max(map(len, own.known)) <= bpe.LONGEST
