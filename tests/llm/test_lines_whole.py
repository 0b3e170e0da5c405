from __future__ import annotations

import random

import corpus_pipeline

from weft.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check(spark, folder, rows, want):
    """The query's removed lines, all that repeat, and the texts after the pipeline's stage."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    df.write.parquet(f"{folder}/documents.parquet")
    got = {x.doc_id: x for x in queries()["op7_lines"](spark, str(folder)).collect()}
    assert {i: list(x.removed) for i, x in got.items()} == {i: want.get(i, []) for i, _ in rows}
    assert all(len(x.removed) == x.n_repeated for x in got.values())
    texts = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert texts == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want.get(i, [])) for i, t in rows}


def test_no_document_is_exempt(spark, tmp_path):
    """Pages of repeats that are no copy of one other document: of their own line, and of lines of several."""
    r = random.Random(3)
    line = lambda: "".join(r.choice("abcdefghijklmnop ") for _ in range(60))
    own, stock = line(), [line() for _ in range(6)]
    rows = [(i, stock[i] + "\n" + line() + "\n" + line()) for i in range(6)]
    rows += [(10, "\n".join([own] * 5)), (11, "\n".join([*stock, line()])), (12, stock[0])]
    check(spark, tmp_path, rows, {10: [1, 2, 3, 4], 11: [0, 1, 2, 3, 4, 5], 12: [0]})


def test_short_lines_by_equality(spark, tmp_path):
    """Short lines repeat if they are equal, not if they are near; empty ones never do."""
    long = "a line of more than twenty-four characters"
    rows = [(0, "All rights reserved.\n\nx\n" + long), (1, "All rights reserved!\n\nfresh words"), (2, "All rights reserved.\n\n" + long + "!\ny"), (3, "x\nx\n\nz"), (4, "All rights reserved.")]
    check(spark, tmp_path, rows, {2: [0, 2], 3: [0, 1], 4: [0]})
