from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from weft.llm import jaccard
from weft.llm.queries import queries
from weft.llm.shared import LOWER


def sets(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    by = {i: sets(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in by.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in by}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in by.items():
        near = defaultdict(int)
        for x in s:
            for j in where[x]:
                near[j] += 1
        for j, both in near.items():
            if j > i and 100 * both >= 75 * (len(s) + len(by[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in by.items()}


def ask(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, cls string, n int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op9_jaccard"](spark, sf).collect()} == brute(rows)


def test_planted(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(55)]
    rows = []
    for size in (5, 6, 8, 9, 12, 17, 30, 65, 66, 140, 260, 300, 1030):
        base = [word() for _ in range(size)]
        for k in range(14):
            own = list(base)
            for _ in range(r.randint(0, max(1, size // 16))):
                at = r.randrange(len(own))
                how = r.randrange(3)
                if how == 0:
                    own[at] = word()
                elif how == 1:
                    own[at:at] = [word() for _ in range(r.randint(1, 1 + size // 12))]
                else:
                    del own[at]
            rows.append((len(rows), " ".join(own).upper() if k % 2 else " ".join(own)))
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(r.randint(5, 60))])) for k in range(150)]
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "one", "ONE", "one two", "a b c d e", "A b\tc d  e", "a b c d e f"])]
    rows += [(len(rows) + k, "same words again and again and again") for k in range(40)]
    r.shuffle(rows)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 100
    assert ask(spark, rows) == want


def test_empty_and_null_ids(spark):
    assert ask(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()), key=str)
    assert got == sorted([(-1, 0, None), (-1, 2, 3), (3, 2, 3), (3, 2, 3)], key=str)


def test_keys_never_miss():
    """Any two sets at the threshold share a key, whatever the rarity of their parts."""
    g = np.random.default_rng(7)
    for trial in range(400):
        rarity = g.integers(0, 3, jaccard.SLOTS).astype(np.uint8)
        n = int(g.integers(1, 400))
        base = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        a = len(base)
        drop = int(g.integers(0, a // 4 + 1))
        add = 0
        while 4 * (a - drop) >= 3 * (a + add + 1):
            add += 1
        add = int(g.integers(0, add + 1)) if trial % 2 else add
        other = np.unique(np.concatenate([base[drop:], g.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 4 * both >= 3 * (a + len(other) - both):
            assert set(jaccard.keys(base, rarity).tolist()) & set(jaccard.keys(other, rarity).tolist())
