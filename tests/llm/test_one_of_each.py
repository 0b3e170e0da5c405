from __future__ import annotations

from weft.llm import jaccard


def test_unlike_texts_under_null_and_equal_ids(spark):
    text = lambda k: " ".join(f"{k}{c}" for c in "abcdefghijkl")
    rows = [(None, text("p")), (None, text("q")), (None, text("q")), (5, text("r")), (5, text("s")), (5, text("s").upper()), (7, text("t")), (None, text("t")), (8, text("t")), (None, None), (5, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in jaccard.one_of_each(df).collect()), key=str)
    want = [(None, text("p")), (None, text("q")), (5, text("r")), (5, text("s")), (7, text("t")), (None, ""), (5, " ")]
    assert got == sorted(want, key=str)
