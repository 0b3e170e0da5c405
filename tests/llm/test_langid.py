from __future__ import annotations

import zlib

import numpy as np
import pytest

from weft.llm import langid
from weft.llm.queries import queries


def parameters(hid=3, c=3, seed=0):
    g = np.random.default_rng(seed)
    shapes = {"ax": (256, 3 * hid), "au": (hid, 3 * hid), "ab": (hid,), "bx": (256, 3 * hid), "bu": (hid, 3 * hid), "bb": (hid,), "o": (2 * hid, c), "ob": (c,)}
    return {k: g.standard_normal(s) * 0.5 for k, s in shapes.items()}


@pytest.mark.parametrize("key", ["ax", "au", "ab", "bx", "bu", "bb", "o", "ob"])
def test_gradients_are_the_slope(key):
    p, g = parameters(), np.random.default_rng(4)
    data, label = g.integers(97, 101, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    grads = langid._gradients(p, data, label)
    places = [tuple(g.integers(0, n) if n != 256 else g.integers(97, 101) for n in p[key].shape) for _ in range(8)]
    for at in places:
        up, down = ({k: x.copy() for k, x in p.items()} for _ in range(2))
        up[key][at] += 1e-5
        down[key][at] -= 1e-5
        slope = (langid.loss(up, data, label) - langid.loss(down, data, label)) / 2e-5
        assert abs(slope - grads[key][at]) < 1e-7


def test_padding_does_not_matter():
    p = {k: x.astype(np.float32) for k, x in parameters().items()}
    net = langid.Network(["a", "b", "c"], langid.Direction(p["ax"], p["au"], p["ab"]), langid.Direction(p["bx"], p["bu"], p["bb"]), p["o"], p["ob"])
    texts = ["abc", "abcdabcd" * 40, "é" * 200, "x"]
    together = langid.predict(net, texts)
    alone = [langid.predict(net, [t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op2_langid"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(lang) and len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double"
    rows = [(i, ("aba cada " if i % 2 else "zyz wixi ") * 9, "x" if i % 2 else "y", 0.5) for i in range(80)]
    rows += [(100, None, "x", 0.1), (101, "", "y", 0.1), (102, "123 !?", "y", 0.1), (None, "aba cada aba", None, 0.1), (104, "aba cada " * 20_000, None, 0.1), (105, "zyz wixi zyz", None, 0.1)]
    docs = spark.createDataFrame(rows, schema)
    net = langid.fit(docs, ~langid.held_out())
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, net, ["doc_id"]).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == "x" and got[104][0] == "x" and got[105][0] == "y"
    nothing = langid.fit(docs.where("false"), ~langid.held_out())
    assert {r.lang_pred for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.where("false"), net, ["doc_id"]).count() == 0
