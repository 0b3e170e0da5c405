r"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Each span becomes a
window: the leading system turn, as many turns before the span as the history limit and the
budget allow, then the span. Only a span's own assistant turns are under the loss mask, so
a repeated target is masked and each target counts once.

A window is ``<s>`` and for each turn ``<|role|>``, a new line, its text and ``</s>`` with a
new line. Control strings inside roles and texts, and backslashes, are replaced by a
backslash and a digit; ``unescape`` gives the exact text back.

Nulls: a null role or text is empty; a null turn comes first; rows of a null conv_id are one
conversation. Equal turn numbers are ordered by role and text. A turn that alone is larger
than the budget has a window of its own, the only kind that exceeds it (over_budget).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY, PER_TURN = 2048, 512, 4
#: The backslash comes first when escaping and last when unescaping.
CONTROL = ("\\", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")


def escape(c: Column) -> Column:
    for k, s in enumerate(CONTROL):
        c = F.replace(c, F.lit(s), F.lit(f"\\{k}"))
    return c


def unescape(c: Column) -> Column:
    for k, s in reversed(list(enumerate(CONTROL))):
        c = F.replace(c, F.lit(f"\\{k}"), F.lit(s))
    return c


def tokens(text: Column) -> Column:
    """Tokens of a turn, by the usual four bytes each, and what its marks take."""
    return (F.ceil(F.octet_length(text) / 4) + PER_TURN).cast("long")


def spans(turns: DataFrame, budget: int, history: int, count: Callable[[Column], Column]) -> DataFrame:
    """Turns numbered per conversation, each with its span and the spans that repeat it.

    A span holds the turns whose prefix sums end in one cell of half the room beside the
    system turn. One that began in the cell before adds less than another half, unless it is
    larger than that: such a turn is a span of its own.
    """
    conv = W.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    t = turns.withColumn("idx", F.row_number().over(order)).withColumn("system", (F.col("idx") == 1) & (F.col("role") == "system"))
    t = t.withColumn("n", count(F.col("text")))
    t = t.withColumn("kept", F.when(F.col("system"), F.col("n")).otherwise(0)).withColumn("own", F.col("n") - F.col("kept"))
    t = t.withColumn("room", F.greatest(F.lit(budget) - F.sum("kept").over(running), F.lit(budget // 2)).cast("long"))
    t = t.withColumn("end", F.sum("own").over(running))
    half = F.expr("room div 2")
    t = t.withColumn("cell", F.expr("(end - 1) div (room div 2)")).withColumn("big", F.col("own") > half)
    fresh = ~F.col("system") & (F.lag("cell").over(order).isNull() | F.lag("system").over(order) | (F.col("cell") != F.lag("cell").over(order)) | F.col("big") | F.lag("big").over(order))
    t = t.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    t = t.withColumn("span", F.greatest(F.lit(1), F.sum(F.col("fresh").cast("int")).over(running)))
    t = t.withColumn("begin", F.col("end") - F.col("own")).withColumn("span_n", F.sum("own").over(W.partitionBy("conv_id", "span")))
    t = t.withColumn("limit", F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - F.col("span_n"))))
    t = t.withColumn("starts", F.when(F.col("fresh"), F.struct("span", "begin", "limit")))
    ahead = conv.orderBy("begin").rangeBetween(1, history)
    t = t.withColumn("later", F.collect_list("starts").over(ahead)).withColumn("spans", F.max("span").over(conv))
    repeats = F.transform(F.filter("later", lambda x: x["begin"] - F.col("begin") <= x["limit"]), lambda x: x["span"])
    member = F.when(F.col("system"), F.sequence(F.lit(1), F.col("spans"))).otherwise(F.concat(F.array("span"), repeats))
    return t.select("conv_id", "idx", "role", "text", "n", "span", member.alias("member"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row per window: conv_id, window, text, n_tokens, over_budget, n_turns, n_context, loss.

    n_context: leading turns that are repeated; loss: spans (begin, length) of text in code
    points from 1. A window's rows number at most what its budget holds.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    t = spans(rows, budget, history, count).withColumn("window", F.explode("member")).withColumn("repeated", F.col("window") != F.col("span"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    t = t.withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat(head, "body", F.lit("</s>\n")))
    before = W.partitionBy("conv_id", "window").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("at", F.lit(len("<s>")) + F.sum(F.length("piece")).over(before) - F.length("piece") + F.length(head) + 1)
    target = ~F.col("repeated") & (F.col("role") == "assistant")
    t = t.withColumn("mask", F.when(target, F.struct(F.col("at").cast("int").alias("begin"), F.length("body").alias("length"))))
    parts = F.sort_array(F.collect_list(F.struct("idx", "piece", "mask")))
    g = t.groupBy("conv_id", "window").agg(parts.alias("parts"), F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_turns"), F.sum(F.col("repeated").cast("int")).alias("n_context"))
    whole = F.concat(F.lit("<s>"), F.array_join(F.transform("parts", lambda p: p["piece"]), ""))
    loss = F.transform(F.filter("parts", lambda p: p["mask"].isNotNull()), lambda p: p["mask"])
    return g.select("conv_id", "window", whole.alias("text"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"), "n_turns", "n_context", loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns: array of (role, text) that are not repeated, targets: texts under the mask)."""
    body = F.expr("substr(text, 4)")
    parts = F.slice(F.split(body, "</s>\n"), F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))
    turn = lambda p: F.struct(
        unescape(F.substr(F.element_at(F.split(p, "\\|>\n"), 1), F.lit(3))).alias("role"), unescape(F.element_at(F.split(p, "\\|>\n"), 2)).alias("text")
    )
    targets = F.transform("loss", lambda m: unescape(F.substr(F.col("text"), m["begin"], m["length"])))
    return formatted.select("conv_id", "window", F.transform(parts, turn).alias("turns"), targets.alias("targets"), F.length("text").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's row per conversation, from what the windows say."""
    own = read_back(formatted).select(
        "conv_id", "window", "chars", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"),
    )
    g = own.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "target"))).alias("all"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("target")).cast("long").alias("loss_chars"),
        F.sha2(joined("target"), 256).alias("loss_sha256"), "formatted_chars",
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7 of the contract: control strings as text."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")


def _sql_escape(c: str) -> str:
    for k, s in enumerate(CONTROL):
        c = f"replace({c}, '{s}', '\\{k}')"
    return c


ORACLE = f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS idx FROM src),
t AS (SELECT *, idx = 1 AND role = 'system' AS sys, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + {PER_TURN} AS n,
      10 + length({_sql_escape("role")}) + length({_sql_escape("text")}) AS piece FROM o),
v AS (SELECT *, CASE WHEN sys THEN 0 ELSE n END AS own,
      greatest({BUDGET} - sum(CASE WHEN sys THEN n ELSE 0 END) OVER w, {BUDGET // 2}) AS room, sum(CASE WHEN sys THEN 0 ELSE n END) OVER w AS e
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (e - 1) // (room // 2) AS cell, own > room // 2 AS big FROM v),
f AS (SELECT *, NOT sys AND coalesce(lag(cell) OVER w IS NULL OR lag(sys) OVER w OR cell <> lag(cell) OVER w OR big OR lag(big) OVER w, false) AS fresh
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
s AS (SELECT *, greatest(1, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS span, e - own AS b FROM f),
k AS (SELECT conv_id, span, min(b) AS starts, greatest(0, least({HISTORY}, max(room) - sum(own))) AS lim FROM s WHERE NOT sys GROUP BY ALL),
h AS (SELECT s.conv_id, sum(s.piece) AS chars FROM s JOIN k ON s.conv_id = k.conv_id AND NOT s.sys AND k.span > s.span AND k.starts - s.b <= k.lim GROUP BY ALL),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '') AS target,
      sum(piece) + 3 * max(span) + (max(span) - 1) * sum(CASE WHEN sys THEN piece ELSE 0 END) AS chars FROM s GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256, CAST(g.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN h ON g.conv_id = h.conv_id
"""
