"""A corpus from raw documents to tokens: language, lines, copies, mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of ``documents``. Between stages the rows are written as Parquet
to the shared folder, so that a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, jaccard, langid, lines, mixing
from weft.llm.queries import vocabulary
from weft.llm.shared import cut, drop, unused

#: A text goes if it has no letter, or if no language's pooled probability is so much of the way from chance to certainty.
CONFIDENT = 0.1


def least(languages: int) -> float:
    """The score below which no language is recognised; one language alone is always it."""
    return 1 / languages + CONFIDENT * (1 - 1 / languages) if languages > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; a missing label is filled with the prediction."""
    net = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    lang, score = unused(docs.columns, "lang_pred", "score")
    named = langid.identify(docs, net, docs.columns, (lang, score)).where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least(len(net.languages))))
    return named.withColumn("lang", F.coalesce("lang", lang)).drop(lang, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document of repeats alone keeps its row, with an empty text."""
    return lines.dedup(docs, mostly=None, exact=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, which the files keep: part by part, row by row."""
    return mixing.in_order(mixing.placed(docs)).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, mix_place, n_tokens, ids, decoded_sha256; mix_place is the row's place in the files it was read from."""
    try:
        file = docs.metadataColumn("_metadata")
        part = F.regexp_extract(file["file_name"], r"part-(\d+)", 1)
        docs = docs.select("doc_id", "text", (F.when(part != "", part.cast("long")) * (1 << 40) + file["row_index"]).alias("place"))
    except AnalysisException:  # rows that come from no file have no place
        docs = docs.select("doc_id", "text", F.lit(None).cast("long").alias("place"))
    return bpe.encode(docs, vocabulary(), bpe.TOKENS, tag=F.col("place")).withColumnRenamed("tag", "mix_place")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: A trained network and a vocabulary file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        new = cut(stage(spark, docs, sf_dir), name)
        if written is not None:
            drop(written)
        docs = written = new
    return STAGES[-1][1](spark, docs, sf_dir)
