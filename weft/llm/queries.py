"""The operators' queries: thin, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, chat, langid, lines, lm, mixing, sharding
from weft.llm.fingerprint import fingerprints
from weft.llm.jaccard import similar
from weft.llm.neardup import near_duplicates

Run = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return similar(_table(spark, folder, "documents")).drop("h", "component")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(_table(spark, folder, "documents").select("doc_id", "text"))


#: The file's place is a parameter; the vocabulary is never copied here.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "embeddings"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    net = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    return langid.identify(docs.withColumn("held_out", langid.held_out()), net, ["doc_id", "held_out"])


def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the order of a mix whose weights go with the root of each source's size."""
    mixed = mixing.mix(_table(spark, folder, "documents").select("doc_id", "source", F.xxhash64("text").alias("text")))
    return mixed.drop("text")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(chat.planted(spark))))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = lm.score(docs, ~lm.held_out() & F.col("doc_id").isNotNull(), lm.ORDER)
    return scored.select("doc_id", lm.held_out().alias("held_out"), *scored.columns[1:])


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_table(spark, folder, "documents"), 24)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's lines, how many of them repeat an earlier one, and which those are: all are removed."""
    return lines.repeats(_table(spark, folder, "documents"), mostly=None, exact=1).drop("h")


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_table(spark, folder, "documents"), vocabulary(), bpe.DIGESTS)


def queries() -> dict[str, Run]:
    return {"op1_embedding_neardup": op1, "op2_langid": op2, "op3_mixing": op3, "op4_chat": op4, "op5_lm": op5, "op6_shards": op6, "op7_lines": op7, "op8_bpe": op8, "op9_jaccard": op9, "op10_fingerprint": op10}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op4_chat": chat.ORACLE}
