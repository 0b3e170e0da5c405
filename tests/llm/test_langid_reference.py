"""The query against a network that is run byte by byte, without windows of several texts, in plain loops."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from weft.llm import langid
from weft.llm.queries import queries


def gate(d, byte, h):
    hid = len(h)
    g, v = d.x[byte].astype(float), h @ d.u.astype(float)
    z, r = (1 / (1 + np.exp(-(g[k * hid : (k + 1) * hid] + v[k * hid : (k + 1) * hid]))) for k in (0, 1))
    n = np.tanh(g[2 * hid :] + r * (v[2 * hid :] + d.b))
    return n + z * (h - n)


def slow(net, text):
    """The language and score of one text: every byte is labelled, a window of WINDOW bytes at a time."""
    if not any(map(str.isalpha, text or "")):
        return langid.UNKNOWN, 0.0
    data, hid, total = text.encode(), net.out.shape[0] // 2, np.zeros(len(net.languages))
    for at in range(0, len(data), langid.WINDOW):
        own = data[at : at + langid.WINDOW]
        ahead, back, h = [], [], np.zeros(hid)
        for byte in own:
            ahead.append(h := gate(net.ahead, byte, h))
        h = np.zeros(hid)
        for byte in reversed(own):
            back.append(h := gate(net.back, byte, h))
        for a, b in zip(ahead, reversed(back), strict=True):
            p = np.exp(np.concatenate([a, b]) @ net.out.astype(float) + net.bias)
            total += p / p.sum()
    return net.languages[int(total.argmax())], float(total.max() / len(data))


def test_query_against_bytes_one_by_one(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(docs, ~langid.held_out())
    got = {r.doc_id: r for r in queries()["op2_langid"](spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if len(r.text or "") < 2500:
            name, score = slow(net, r.text)
            assert got[r.doc_id].score == pytest.approx(score, abs=2e-4)
            assert got[r.doc_id].lang_pred == name or score < 0.5


def test_sample_is_bounded_whatever_the_labels(spark, monkeypatch):
    """One hot text is one of its language, many labels are many samples of the bound, and both are the same on any run."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, names: seen.append(sorted(zip(names, texts, strict=True))))
    rows = [(k, "the hot text", "en") for k in range(3000)] + [(k, f"text number {k} of many", "en") for k in range(3000, 6000)] + [(k, f"words {k}", f"l{k % 60}") for k in range(6000, 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for _ in range(2):
        langid.fit(df.repartition(7), ~langid.held_out())
    assert seen[0] == seen[1]
    per = {}
    for name, text in seen[0]:
        per.setdefault(name, []).append(text)
    assert len(per) == 61 and max(map(len, per.values())) <= 20 and all(len(set(t)) == len(t) for t in per.values())


def test_what_is_far_from_every_language_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "")
    lettered = [r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    assert kept.count() >= 0.999 * len(lettered)
    assert corpus_pipeline.least(1) == 0 and math.isclose(corpus_pipeline.least(4), 0.325)
