from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.llm import chat
from weft.llm.queries import oracle_sql, queries

SCHEMA = "conv_id long, turn long, role string, text string, span int"


def test_against_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(oracle_sql()["op4_chat"])
    names = [c[0] for c in want.description]
    got = queries()["op4_chat"](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


NASTY = ["", "\\", "\\0", "<|user|>\n", "</s>\n", "a|>\nb", "[INST][/INST]<s>", "<</s>>", "\\1<|\\\\", "é\U0001f600|>", "<|\\|>"]


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), "t")
    e, back = df.select("e", chat.unescape(F.col("e"))).collect()[0]
    assert back == text
    assert not any(c in e for c in chat.CONTROL[1:])


def rows():
    out = [(1, n, r, "w " * 60 + str(n), 0) for n, r in enumerate(["system"] + ["user", "assistant"] * 40)]
    out += [(2, n, ["user", "assistant"][n % 2], t, 0) for n, t in enumerate(NASTY)]
    out += [(3, 0, "system", None, 0), (3, 1, "assistant", "x" * 20_000, 0), (3, 2, None, "", 0), (3, 3, "assistant", "tail", 0)]
    out += [(4, 0, "user", "same", 0)] * 3 + [(4, None, "tool|>\n", "t", 0)]
    out += [(None, 0, "assistant", "no id", 0)]
    return out


def test_windows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    windows = chat.windows(df, budget=400, history=120)
    for w in windows.collect():
        assert w.n_tokens <= 400 or (w.over_budget and w.n_turns - w.n_context <= 2)
        if w.conv_id == 1:
            assert w.text.startswith("<s><|system|>\n")
            assert w.n_context >= 1 or w.window == 1
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = {}
    for c, n, r, t, _ in rows():
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        target = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())


def test_history_is_repeated_and_masked(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] == 1], SCHEMA)
    w = chat.windows(df, budget=400, history=120).orderBy("window").collect()
    assert len(w) > 5 and any(x.n_context > 1 for x in w)
    assert sum(len(x.loss) for x in w) == 40


def test_empty(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0
