from __future__ import annotations

from pyspark.sql import functions as F

from weft.llm import langid


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda snippets, names: seen.extend(zip(names, snippets, strict=True)))
    rows = [(f"copied text {k}", "en") for k in range(40) for _ in range(150)] + [(f"own text {k}", "en") for k in range(2000)] + [("un mot", "fr")] * 500
    langid.fit(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    assert len(seen) == len(set(seen))
    assert [x[0] for x in seen].count("en") == langid.PER_LANGUAGE and [x[0] for x in seen].count("fr") == 1
