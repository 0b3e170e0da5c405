from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_bpe import whole
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_lines import brute as repeated
from weft.llm.shared import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against brute force on all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90_001, None, "en", "src1", 0), (90_002, "12 34", None, "src2", 5), (None, "The and of the that with for", None, None, 28)]
    docs = cut(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "docs")
    rows = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == docs.columns
            out = cut(out, name)
        seen[name] = (docs, out)
        docs = out
    kept = {r.doc_id: r for r in seen["language_id"][1].collect()}
    assert set(rows) - set(kept) <= {90_001, 90_002} | {i for i, r in rows.items() if not any(map(str.isalpha, r.text or ""))}
    assert 90_001 not in kept and 90_002 not in kept and None in kept and kept[None].lang is not None

    lines = {r.doc_id: r.text for r in seen["line_dedup"][1].collect()}
    exact = {i: [x for x in r.text.split("\n")] for i, r in kept.items()}
    assert set(lines) == set(kept)
    assert all(set(t.split("\n")) <= set(exact[i]) | {""} for i, t in lines.items())

    want = groups([(-1 if i is None else i, t) for i, t in lines.items()])
    near = {-1 if r.doc_id is None else r.doc_id for r in seen["near_duplicates"][1].collect()}
    assert near == {i for i, (n, c) in want.items() if i == c or not n}

    assert sorted(map(str, seen["mixture"][1].collect())) == sorted(map(str, seen["near_duplicates"][1].collect()))
    texts = {r.doc_id: r.text for r in seen["mixture"][1].collect()}
    final = seen["encoding"][1].collect()
    assert {r.doc_id: list(r.ids) for r in final} == {i: whole(t)[0] for i, t in texts.items()}
    assert len({r.mix_place for r in final}) == len(final) == len(texts)


def test_mix_shows_in_places(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma"], k=4)), "en", "big" if i % 5 else "small", 9) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = cut(corpus_pipeline.mixture(spark, docs, SF), "mixed")
    out = corpus_pipeline.encoding(spark, mixed, SF).join(docs.select("doc_id", "source"), "doc_id").orderBy("mix_place").collect()
    head = [x.source for x in out[:600]]
    assert 0.28 < head.count("small") / 600 < 0.39  # roots of 400 and 1600 are as 1 to 2


def test_line_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 400").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    gone = repeated(rows, mostly=None, exact=1)
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}


def test_whole_run_and_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 100
