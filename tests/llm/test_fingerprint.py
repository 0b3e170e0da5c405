from __future__ import annotations

import hashlib

from weft.llm.fingerprint import canonical, clashing, edited, exact_groups, fingerprints
from weft.llm.queries import queries

SCHEMA = "doc_id long, text string, extra int"


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        e = edited(t, n)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(e) == canonical(t)), float(canonical(t) == canonical(n)))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op10_fingerprint"](spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == brute(docs)
    assert len(got) == len(docs)
    print_of, text_of = {r.doc_id: r.fingerprint for r in got}, dict(docs)
    forms = {}
    for i, p in print_of.items():
        assert forms.setdefault(p, canonical(text_of[i])) == canonical(text_of[i])
    assert len(forms) == len({canonical(t) for t in text_of.values()})


def test_odd_rows(spark):
    rows = [(5, "ﬁne  Straße", 1), (4, "FINE strasse", 1), (3, None, 1), (2, "", 1), (1, "x" * 100_000, 1), (9, "é", 1), (8, "é", 1), (7, "\U0001f600a", 1)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([r[:2] for r in rows])
    assert {i: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for i, r in got.items()} == want
    assert got[5].fingerprint == got[4].fingerprint and got[9].fingerprint == got[8].fingerprint and got[3].fingerprint == got[2].fingerprint
    assert got[5].near_next == 1.0 and got[4].near_next == 0.0


def test_ties_nulls_empty(spark):
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(1, "ab", 0)] * 3 + [(None, "cd", 0), (None, None, 0)]
    got = fingerprints(spark.createDataFrame(same, SCHEMA))
    assert got.count() == 5
    assert sorted(r.n_docs for r in exact_groups(got).collect()) == [1, 1, 3]
    one = fingerprints(spark.createDataFrame([(3, "abcd", 0)], SCHEMA)).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_bytes_are_compared(spark):
    forms = spark.createDataFrame([("h1", bytearray(b"a")), ("h1", bytearray(b"b")), ("h2", bytearray(b"a")), ("h2", bytearray(b"a"))], "h string, form binary")
    assert [r.h for r in clashing(forms).collect()] == ["h1"]
