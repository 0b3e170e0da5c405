from __future__ import annotations

import hashlib
import random

from weft.llm import bpe
from weft.llm.queries import queries, vocabulary

PATH = vocabulary()
ODD = ["", " ", "a", "'s", "!!'s don't", "x" * 50, "aé<|endoftext|>b's  <|startoftext|>x", "é" * 30, "İΑΣ ẹ́", "　a\x85b\x1cc", "12345", "\U0001f600" * 9, "<|endof text|>", "á́̀" * 20]


def whole(text):
    t = bpe.tokenizer(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def strings(n, size, seed=3):
    r = random.Random(seed)
    kinds = ["abcdefgh", "a", "ab", "the of and in'sxé", "!?.'s're<|>", "áè", "0123ab", "<|endoftext|>ab", "\U0001f600中文"]
    return ["".join(r.choice(kinds[i % len(kinds)]) for _ in range(r.randint(1, size))) for i in range(n)]


def test_tree_is_the_encoding():
    encode = bpe.leaf(PATH)
    for text in ODD + strings(250, 900) + ["a" * 3000, "<|endoftext|>" * 60, "ab" * 999 + "c"]:
        for size in (16, 61, 200):
            assert [i for i, _, _ in bpe.tree(encode, text, size)] == whole(text)[0], (size, text)


def test_runs_are_the_encoding():
    runs = bpe.Runs(PATH)
    for text in ODD + [" ".join(strings(5, 40, s)) for s in range(80)] + ["x" * 9000 + " y"]:
        ids, decoded = whole(text)
        assert runs.text(text) == (" ".join(map(str, ids)), len(ids), decoded), text


def test_parts_hold_the_text():
    for text in strings(60, 400):
        for size in (7, 50):
            cut = bpe.parts(text, size)
            assert "".join(t for _, _, t in cut) == text and all(0 < len(t) <= size for _, _, t in cut)
            assert [h for h, _, _ in cut][1:] == [o for _, o, _ in cut][:-1]


def test_long_texts_over_tasks(spark):
    texts = ["", None, "short one", "word " * 300, "q" * 700, "ab" * 400 + " tail " + "é" * 500, "<|endoftext|>" * 40] + strings(20, 900, 8)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, "q" * 700, "copy"), (None, "z" * 300, "n")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, part=100)
    want = sorted((-1 if i is None else i, len(whole(t)[0]), whole(t)[0], whole(t)[1]) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in got.collect()) == want


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, decoded = whole(t)
        want[i] = (len(ids), digest(" ".join(map(str, ids))), digest(decoded))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op8_bpe"](spark, sf).collect()} == want
