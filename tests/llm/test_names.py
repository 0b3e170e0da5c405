"""Every name that an operator uses inside may be a column of the documents; its values come back unchanged."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.llm import bpe, fingerprint, jaccard, langid, lines, lm, mixing, sharding
from weft.llm.queries import vocabulary
from weft.llm.shared import unused

#: Names inside the operators, results, and odd ones.
NAMES = """_c _s _n _o _b _q _j _r _k _h _i _id _lang _score _place _metadata row s c n o b k q j r i h id at line removed cls key low component node u v a b2
    release due slot shard mix_block mix_place bucket ghost range size text_crc32 lang_pred score held_out tag copies part pieces part_ row_ a.b `""".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven eight\nthe same long line of words stands here", "the same long line of words stands here", None, "", "unlike all the others is this short text of words"]
    texts += [texts[0] + " nine", "the same long line of words stands here!"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}", len(t or ""), *[f"{n}={i}" for n in NAMES]) for i, t in enumerate(texts)]
    fields = ["doc_id long", "text string", "lang string", "source string", "n_chars int", *["`" + n.replace("`", "``") + "` string" for n in NAMES]]
    return spark.createDataFrame(rows, ", ".join(fields))


def own(row, skip=()):
    return {n: row[n] for n in NAMES if n not in skip}


def unchanged(rows, skip=()):
    assert rows
    for r in rows:
        assert own(r, skip) == {n: f"{n}={r['doc_id']}" for n in NAMES if n not in skip}


def test_mixing(docs):
    out = mixing.mix(docs)
    assert len(set(out.columns)) == len(out.columns)
    unchanged(out.collect(), mixing.PLACE)
    unchanged(mixing.in_order(mixing.placed(docs)).select("row.*").collect())


def test_lines(docs):
    out = lines.dedup(docs, mostly=None, exact=1)
    assert out.columns == docs.columns
    rows = out.collect()
    unchanged(rows)
    assert {r.doc_id: (r.text, r.n_chars) for r in rows}[1] == ("", 0)
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_jaccard(docs):
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    unchanged(out.collect())
    assert jaccard.similar(docs).count() == docs.count()


def test_langid(docs):
    net = langid.fit(docs, ~langid.held_out())
    names = unused(docs.columns, "lang_pred", "score")
    out = langid.identify(docs, net, docs.columns, names)
    assert names == ["lang_pred_", "score_"] and out.columns == [*docs.columns, *names]
    unchanged(out.collect())
    unchanged(langid.identify(docs, net, docs.columns).collect(), ("lang_pred", "score"))


def test_those_that_look_at_their_own_columns_alone(docs, tmp_path):
    n = docs.count()
    assert bpe.encode(docs, vocabulary(), tag=F.col("n_chars")).columns == ["doc_id", "tag", "n_tokens", "ids", "decoded"]
    assert lm.score(docs, F.lit(True)).count() == fingerprint.fingerprints(docs).count() == sharding.assign(docs).count() == n
    sharding.write(docs, str(tmp_path / "shards"), 3)
    out = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert out.count() == n
    unchanged(out.collect(), ("shard", "slot"))


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_duplicates", "mixture"])
def test_stages(docs, name):
    import corpus_pipeline

    out = dict(corpus_pipeline.STAGES)[name](docs.sparkSession, docs, "")
    assert out.columns == docs.columns
    unchanged(out.collect())


def test_last_stage(docs):
    import corpus_pipeline

    out = corpus_pipeline.encoding(docs.sparkSession, docs, "")
    assert "mix_place" in out.columns and out.count() == docs.count()
