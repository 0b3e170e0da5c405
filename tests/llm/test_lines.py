from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weft.llm import lines
from weft.llm.queries import queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edit(r, s, k, alphabet):
    s = list(s)
    for _ in range(k):
        at = r.randrange(len(s) + 1)
        how = r.randrange(3)
        if how == 0:
            s.insert(at, r.choice(alphabet))
        elif s and how == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = r.choice(alphabet)
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance(spark, edits):
    r = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a", "b"), ("\U0001f600é", "é")]
    for alphabet in ("ab", "abcdé\U0001f600"):
        for _ in range(350):
            a = "".join(r.choice(alphabet) for _ in range(r.randint(0, 24)))
            pairs.append((a, edit(r, a, r.randint(0, edits + 3), alphabet)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", lines.bounded_distance(F.col("a"), F.col("b"), edits).alias("d"), lines.near(F.col("a"), F.col("b"), edits).alias("near")).collect()
    for x in got:
        want = distance(x.a, x.b)
        assert (x.d == want) if want <= edits else (x.d > edits), (x.a, x.b, want, x.d)
        assert x.near == (want <= edits)


def classes(texts, edits=2, shortest=lines.MIN_LINE, exact=None):
    """A name for the class of each line that counts; lines under ``shortest`` count from ``exact`` characters, by equality."""
    equal = {x: x for t in texts if t for x in t.split("\n") if exact is not None and exact <= len(x) < shortest}
    every = sorted({x for t in texts if t for x in t.split("\n") if len(x) >= shortest})
    parent = {x: x for x in every}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                parent[find(a)] = find(b)
    return equal | {x: find(x) for x in every}


def brute(rows, mostly=lines.MOSTLY, **how):
    """removed line numbers by row; rows in order of doc_id, each once."""
    cls, seen, out = classes([t for _, t in rows], **how), set(), {}
    for i, t in sorted(rows):
        own = (t or "").split("\n") if t is not None else []
        gone = []
        for n, x in enumerate(own):
            if x in cls:
                if cls[x] in seen:
                    gone.append(n)
                seen.add(cls[x])
        chars = sum(map(len, own))
        out[i] = [] if mostly is not None and sum(len(own[n]) for n in gone) > mostly * chars else gone
    return out


def documents():
    r = random.Random(11)
    line = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    stock = [line(n) for n in (24, 25, 26, 27, 40, 41, 75, 200)]
    rows = []
    for i in range(70):
        own = [line(r.randint(0, 90)) for _ in range(6)]
        own += [edit(r, r.choice(stock), r.choice([0, 0, 1, 2, 3, 4]), "abcdef é") for _ in range(3)]
        r.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, "\n\n\n"), (204, stock[4]), (205, stock[4] + "\n" + stock[4] + "x"), (206, "z" * 30_000)]
    return rows


@pytest.mark.parametrize("edits", [1, 2])
def test_against_brute_force(spark, edits):
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, h int, removed string")
    got = {x.doc_id: list(x.removed) for x in lines.repeats(df, edits=edits).collect()}
    want = brute(rows, edits=edits)
    assert got == want
    assert sum(map(len, want.values())) > 50


def test_dedup_keeps_columns_and_clean_texts(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows] + [(None, "n", 1, "s"), (204, rows[-3][1], 9, "s")], "doc_id long, text string, n_chars long, h string")
    out = lines.dedup(df)
    assert out.schema == df.schema and out.count() == len(rows) + 2
    want = brute(rows)
    got = {x.doc_id: x for x in out.collect()}
    for i, t in rows:
        if not want[i]:
            assert got[i].text == t
        else:
            kept = [x for n, x in enumerate(t.split("\n")) if n not in want[i]]
            assert got[i].text == "\n".join(kept) and got[i].n_chars == len(got[i].text)


def test_empty(spark):
    assert lines.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_exact_repeats(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: x for x in queries()["op7_lines"](spark, sf).collect()}
    assert set(got) == {i for i, _ in rows}
    seen, least = set(), defaultdict(int)
    for i, t in sorted(rows):
        for x in t.split("\n"):
            if len(x) >= lines.MIN_LINE:
                least[i] += x in seen
                seen.add(x)
    assert all(got[i].n_repeated >= least[i] for i, _ in rows)
