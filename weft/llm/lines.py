"""Repeated lines, by a segment-partition edit join.

A line is split into one segment more than the edits allowed. Two lines within that distance
share a segment at nearly the same place, so a line's segments are indexed with its length
and the segment's number, and every line probes, for each length that may be near its own,
just the substrings that can match. Candidates pass bounds on length and on the
parities of their character pairs, lose their common beginning and end, and what
is left is compared by a banded bit-parallel edit distance: one 64-bit word holds a column
of the band. All of it is DataFrame expressions.

Equal lines are one from the start, by a 64-bit hash. Keys are shuffled, texts are not: only the
lines that meet another one under a key are fetched, through a filter of bits of bounded
size. The candidates of a key are first its smallest indexed line with each other line; where
that leaves several components, all pairs across them that pass the bounds are tried.

Of a class of lines the first occurrence (by doc_id, text and line number) stays. Lines of at
least MIN_LINE characters are compared with edits; with ``exact`` 1 all shorter ones that are
not empty count by equality, as in the query and the pipeline. By default they do not. Every document loses its repeats, also one that is
nothing else; a caller can ask by ``mostly`` that a document of which a larger share repeats
is left whole, which too is the default of ``repeats`` but neither of the query nor the pipeline.

Nulls: a null text has no lines and stays null; a null doc_id comes first. Rows that are
wholly equal share one decision, so both keep what either keeps. Other columns may have any
names and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.shared import Tables, release

EDITS, MIN_LINE, MOSTLY = 2, 24, 0.5
#: Words of the filter of lines that are fetched, at least and at most.
WORDS = (1 << 10, 1 << 20)


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(d, i, move): a line looks, for lines shorter by d, for segment i of such a length, moved by so much.

    Moves are at most the edits that can have happened before the segment and, seen from the
    end, after it. The probes (0, i, 0) are a line's own segments, by which it is indexed.
    """
    return [(d, i, move) for d in range(edits + 1) for i in range(edits + 1) for move in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def keyed(lines: DataFrame, edits: int = EDITS, indexed: bool = False) -> DataFrame:
    """(id, key, indexed) of every probe of the lines (id, line, n), or of their own segments alone.

    The probes are rows before anything is computed: a few expressions then serve them all.
    """
    wanted = [p for p in probes(edits) if not indexed or (p[0], p[2]) == (0, 0)]
    every = F.array(*[F.struct(*(F.lit(x).alias(c) for x, c in zip(p, ("d", "i", "move"), strict=True))) for p in wanted])
    rows = lines.select("id", "line", "n", F.explode(every).alias("p")).select("id", "line", "n", (F.col("n") - F.col("p.d")).alias("length"), "p.*")
    rows = rows.select("*", F.expr(f"int(length div {edits + 1})").alias("size"), F.expr(f"{edits + 1} - int(length % {edits + 1})").alias("short"))  # the later segments take what is over
    rows = rows.select("*", F.expr("size * i + greatest(0, i - short) + move").alias("at"), F.expr("size + int(i >= short)").alias("own"))
    rows = rows.where("at >= 0 AND at + own <= n AND own > 0")
    return rows.select("id", F.xxhash64("i", "length", F.substr("line", F.col("at") + 1, F.col("own"))).alias("key"), F.expr("d = 0 AND move = 0").alias("indexed"))


def bounded_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """The edit distance of two strings in code points, or something above ``edits`` if it is.

    Bit k of a word is row j - edits + k of column j. VP and VN say where the column goes up
    and down by one; the value followed is the band's last diagonal, then the last row.
    """
    return _let(
        F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("m"), F.length(b).alias("n")), lambda t: _banded(t["x"], t["y"], t["m"], t["n"], edits)
    )


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once; an expression used twice would else be written out twice."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _banded(x: Column, y: Column, m: Column, n: Column, edits: int) -> Column:
    w = 2 * edits + 1
    every = F.lit((1 << w) - 1).cast("long")
    off = lambda v: v.bitwiseXOR(every)
    bit = lambda v, k: F.call_function("shiftrightunsigned", v, k).bitwiseAND(F.lit(1).cast("long"))

    def matches(j: Column) -> Column:
        near = F.slice(x, F.greatest(F.lit(1), j - edits), F.least(j + edits, m) - F.greatest(F.lit(1), j - edits) + 1)
        lowest = F.greatest(F.lit(0), edits + 1 - j)
        return _let(F.get(y, j - 1), lambda c: _let(near, lambda row: sum((F.when(F.get(row, F.lit(k) - lowest) == c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(w)), F.lit(0).cast("long"))))

    words = F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(j.alias("j"), matches(j).alias("eq")))

    def first(s: Column, e: Column) -> Column:
        d0 = ((e["eq"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(e["eq"]).bitwiseOR(s["vn"]).bitwiseAND(every)
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), d0.alias("d0"), s["c"].alias("c"), e["j"].alias("j"))

    def second(t: Column) -> Column:
        hp, hn = t["vn"].bitwiseOR(off(t["d0"].bitwiseOR(t["vp"]))), t["d0"].bitwiseAND(t["vp"])
        return F.struct(t["d0"].alias("d0"), hp.alias("hp"), hn.alias("hn"), t["c"].alias("c"), t["j"].alias("j"))

    def third(t: Column) -> Column:
        down = F.shiftright(t["d0"], 1)
        k = F.least(F.lit(w - 1), m - t["j"] + edits)
        c = t["c"] + F.when(t["j"] + edits <= m, F.lit(1).cast("long") - bit(t["d0"], F.lit(w - 1))).otherwise(bit(t["hp"], k) - bit(t["hn"], k))
        return F.struct(t["hn"].bitwiseOR(off(down.bitwiseOR(t["hp"]))).alias("vp"), down.bitwiseAND(t["hp"]).alias("vn"), c.alias("c"))

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(edits), m).cast("long").alias("c"))
    banded = F.aggregate(words, start, lambda s, e: _let(_let(first(s, e), second), third), lambda s: s["c"])
    return F.when(F.abs(m - n) > edits, F.lit(edits + 1)).when(F.least(m, n) == 0, F.greatest(m, n)).otherwise(banded.cast("int"))


def _agreement(a: Column, b: Column, most: Column) -> Column:
    """How many characters two strings begin with in common, ``most`` at the most: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(25))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= most) & (F.substr(a, low + 1, s) == F.substr(b, low + 1, s)), low + s).otherwise(low))


def near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are within ``edits``; common ends are cut off first."""
    both = F.struct(a.alias("a"), b.alias("b"), F.reverse(a).alias("ra"), F.reverse(b).alias("rb"), F.length(a).alias("m"), F.length(b).alias("n"), F.least(F.length(a), F.length(b)).alias("most"))

    def cut_head(t: Column) -> Column:
        return F.struct(*[t[c].alias(c) for c in ("a", "b", "ra", "rb", "m", "n", "most")], _agreement(t["a"], t["b"], t["most"]).alias("h"))

    def cut_tail(t: Column) -> Column:
        return F.struct(*[t[c].alias(c) for c in ("a", "b", "m", "n", "h")], _agreement(t["ra"], t["rb"], t["most"] - t["h"]).alias("t"))

    def rest(t: Column) -> Column:
        return F.struct(*[F.substr(t[c], t["h"] + 1, t[size] - t["h"] - t["t"]).alias(c) for c, size in (("a", "m"), ("b", "n"))])

    return _let(_let(_let(_let(both, cut_head), cut_tail), rest), lambda t: bounded_distance(t["a"], t["b"], edits)) <= edits


def sketched(lines: DataFrame) -> DataFrame:
    """The lines (id, line, n) with ``sketch``: parities of their pairs of neighbouring characters in 124 bits; an edit changes four of them at most."""
    letters = F.split("line", "")
    pairs = lines.select("id", F.explode(F.arrays_zip(letters.alias("x"), F.slice(letters, F.lit(2), F.greatest(F.lit(1), F.col("n"))).alias("y"))).alias("c"))
    at = F.pmod(F.xxhash64("c.x", "c.y"), F.lit(124)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 62)
    none = F.lit(0).cast("long")
    sums = pairs.select("id", at.alias("at")).groupBy("id").agg(F.bit_xor(F.when(F.col("at") < 62, bit).otherwise(none)).alias("p"), F.bit_xor(F.when(F.col("at") < 62, none).otherwise(bit)).alias("q"))
    return lines.join(sums, "id").select("id", "line", "n", F.struct("p", "q").alias("sketch"))


def _possible(x: str, y: str, edits: int) -> Column:
    """Bounds on lengths and sketches, as a join condition."""
    apart = sum((F.bit_count(F.col(f"{x}.sketch")[c].bitwiseXOR(F.col(f"{y}.sketch")[c])) for c in ("p", "q")), F.lit(0))
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= edits) & (apart <= 4 * edits)


def _verified(pairs: DataFrame, wanted: DataFrame, edits: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) of line ids whose lines are within the edits; texts travel for pairs that pass the bounds."""
    small = wanted.select("id", "n", "sketch")
    maybe = pairs.join(small.alias("p"), F.col("a") == F.col("p.id")).join(small.alias("q"), (F.col("b") == F.col("q.id")) & _possible("p", "q", edits)).select("a", "b")
    one = maybe.join(wanted.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    two = one.join(wanted.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return tables.cut(two.where(near(F.col("x"), F.col("y"), edits)).select("a", "b"), "links")


def _exploded(docs: DataFrame, *columns: Column) -> DataFrame:
    rows = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.withColumn("n", F.length("line")).withColumn("id", F.xxhash64("line"))


def _fetched(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, n) of the lines that have one of the ids, each once.

    A filter of eight bits for each id, WORDS[1] words of 64 at most, spares the others the
    shuffle; it is broadcast. Beyond that size it lets more through, which the join then drops.
    """
    words = min(WORDS[1], max(WORDS[0], 1 << (ids.count() // 8).bit_length()))
    word, bit = F.pmod(F.shiftright("id", 6), F.lit(words)), F.col("id").bitwiseAND(F.lit(63).cast("long")).cast("int")
    marks = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    passed = lines.withColumn("word", word).join(F.broadcast(marks), "word").where(F.getbit("marks", bit) == 1)
    # an inner join: a semi-join would be moved ahead of the filter
    return passed.select("id", "line", "n").join(ids.distinct(), "id").groupBy("id").agg(F.first("line").alias("line"), F.first("n").alias("n"))


def line_classes(docs: DataFrame, edits: int = EDITS, shortest: int = MIN_LINE, tables: Tables | None = None) -> DataFrame:
    """(id, component) of the lines that are near another line; a line of no class has no row."""
    tables = tables or Tables()
    cut = tables.cut
    lines = _exploded(docs).where(F.col("n") >= shortest).select("id", "line", "n")
    lowest = keyed(lines, edits, True).groupBy("key").agg(F.min("id").alias("low"))
    met = keyed(lines, edits).join(lowest, "key").where("id != low").select("key", "low", "id", "indexed")
    met = cut(met.groupBy("key", "low", "id").agg(F.max("indexed").alias("indexed")), "met")
    release(docs.sparkSession)
    ids = cut(met.select(F.explode(F.array("low", "id")).alias("id")).distinct(), "ids")
    fetched = cut(_fetched(lines, ids), "fetched")
    wanted = cut(sketched(fetched), "wanted")
    links = _verified(met.select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), wanted, edits, tables)
    named = components(links, tables)
    mine = met.where("indexed").select("key").distinct()
    members = met.join(mine, "key").join(named.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = cut(members.join(wanted.select("id", "n", "sketch"), "id").select("key", "id", "indexed", "component", "n", "sketch"), "open")
    across = (F.col("p.key") == F.col("q.key")) & (F.col("p.component") != F.col("q.component")) & _possible("p", "q", edits)
    pair = open_.where("indexed").alias("p").join(open_.alias("q"), across)
    second = cut(pair.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct(), "candidates")
    tables.drop(met, ids, fetched, open_)
    if not second.isEmpty():
        named = components(links.unionAll(_verified(second, wanted, edits, tables)), tables)
    return named.select(F.col("node").alias("id"), "component")


def repeats(docs: DataFrame, edits: int = EDITS, shortest: int = MIN_LINE, mostly: float | None = MOSTLY, exact: int | None = None) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, h, n_lines, n_repeated, repeated_chars, removed (line numbers from 0).

    With ``mostly`` None all repeats are removed, from every document. Lines shorter than
    ``shortest`` count from ``exact`` characters on, by equality.
    """
    with Tables() as tables:
        doc_id, h = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")
        least = shortest if exact is None else min(shortest, max(1, exact))
        where = tables.cut(_exploded(docs, doc_id, h).where(F.col("n") >= least).select("doc_id", "h", "at", "n", "id"), "places")
        classes = tables.cut(line_classes(docs, edits, shortest, tables), "classes")
        placed = where.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
        heads = placed.groupBy("component").agg(F.min(F.struct("doc_id", "h", "at")).alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
        again = placed.join(heads, "component").where(F.struct("doc_id", "h", "at") != F.col("head"))
        # rows that are wholly equal have each place twice
        per = again.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("gone"))
        per = tables.cut(per.select("doc_id", "h", F.transform("gone", lambda x: x["at"]).alias("ats"), F.aggregate("gone", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("repeated_chars")), "repeats")
        tables.keep(per)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    chars = F.coalesce(F.length("text") - n_lines + 1, F.lit(0)).cast("long")
    totals = docs.select(doc_id, h, n_lines.alias("n_lines"), chars.alias("chars")).distinct()
    out = totals.alias("t").join(per.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.h") == F.col("p.h")), "left")
    none = F.array().cast("array<int>")
    copied = F.lit(False) if mostly is None else F.coalesce("repeated_chars", F.lit(0)) > F.col("chars") * mostly
    return out.select(
        "t.doc_id", "t.h", "n_lines", F.size(F.coalesce("ats", none)).alias("n_repeated"), F.coalesce("repeated_chars", F.lit(0)).alias("repeated_chars"),
        F.when(copied, none).otherwise(F.coalesce("ats", none)).alias("removed"),
    )


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The documents, same columns, without the lines that repeat; a text changes only where a line goes.

    Where n_chars is a column it is made to fit the new text.
    """
    changed = repeats(docs, **how).where(F.size("removed") > 0).select("doc_id", "h", "removed")
    # columns of any names travel as one struct
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("k"))
    rows = own.join(changed, (F.col("k") == changed["h"]) & F.col("i").eqNullSafe(changed["doc_id"]), "left").select("row", "removed")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    out = []
    for f in docs.schema.fields:
        was = F.col("row").getField(f.name)
        if f.name == "text":
            was = text
        elif f.name == "n_chars":
            was = F.when(F.col("removed").isNull(), was).otherwise(F.length(kept).cast(f.dataType))
        out.append(was.alias(f.name))
    return rows.select(*out)
