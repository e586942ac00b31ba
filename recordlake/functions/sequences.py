"""Sequences compared inside the row: common subsequences of letters, ordered differences of lines.

Differences are expressions over arrays; nothing is exploded, so nothing is shuffled, and a text is worked on where it
was read.  Arrays are sorted and cut rather than searched, so a text of a million lines takes sorts and single passes.
Common letters are counted in Python, by batches of rows.
"""
from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import col, let, settled

CHUNK = 512
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]"


# ---- letters -----------------------------------------------------------------------------------------------------

def letters(c) -> Column:
    """The letters of a text (code points), as an array."""
    return F.regexp_extract_all(col(c), F.lit("(?s)."), F.lit(0))


def _common(a: str, b: str) -> int:
    """A row of the table of common lengths is kept as bits, one for each letter of the longer text, and the next letter
    of the shorter one changes them all by one addition.  What both begin with, and end with, is in every longest one."""
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = (a[:len(a) - tail], b[:len(b) - tail]) if tail else (a, b)
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    bit = 1
    for x in a if b else "":
        places[x] = places.get(x, 0) | bit
        bit <<= 1
    full = row = (1 << len(a)) - 1
    for x in b:
        here = row & places.get(x, 0)
        if here:
            row = (row + here | row - here) & full
    return head + tail + len(a) - row.bit_count()


def common_letters(a, b) -> Column:
    """Length of the longest common subsequence of two texts, exact and the same either way round; null for null."""
    @F.pandas_udf("int")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _common(p, q) for p, q in zip(x, y)], dtype="Int32")
    return common(col(a), col(b))


def matching_ratio(a, b) -> Column:
    """DF1, exact form: twice the longest common subsequence over both lengths; 1 for two empty texts, null for null."""
    total = F.length(col(a)) + F.length(col(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common_letters(a, b) / total)


# ---- arrays ------------------------------------------------------------------------------------------------------

def part(items: Column, start: Column, n: Column) -> Column:
    """n items from place `start` (from 1) on.  Unlike `slice` it does not copy the whole array first."""
    places = F.sequence(start, F.greatest(start + n - 1, start))
    return F.transform(F.filter(places, lambda i: i < start + n), lambda i: F.get(items, i - 1))


def blocks(items: Column, breaks) -> Column:
    """An array cut where `breaks(item, next item)` holds."""
    def cut(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
        starts = F.filter(places, lambda t: (t < F.size(s)) & F.when(t == 0, True).otherwise(breaks(F.get(s, t - 1), F.get(s, t))))
        return let(starts, lambda p: F.transform(p, lambda at, k: part(s, at + 1, F.coalesce(F.get(p, k + 1), F.size(s)) - at)))
    return let(items, cut)


def heaviest_chain(pieces: Column) -> Column:
    """Of pieces (t, r, w) in order of t, those of the chain with rising r that weighs most; of equal ones the one that ends latest.

    A fold keeps the best chains by their last r, each heavier than those that end lower; it is taken in chunks, so that
    what it writes down is not copied at every step.
    """
    entry = "array<struct<r:bigint,best:bigint,k:int>>"
    link = "array<struct<best:bigint,before:int>>"
    none = F.struct(F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("best"), F.lit(-1).alias("k"))

    def add(s: Column, x: Column) -> Column:
        return let(F.filter(s["front"], lambda f: f["r"] < x["r"]), lambda low: let(
            F.coalesce(F.try_element_at(low, F.lit(-1)), none), lambda p: let(p["best"] + x["w"], lambda best: F.struct(
                F.concat(low, F.array(F.struct(x["r"].cast("bigint").alias("r"), best.cast("bigint").alias("best"), s["k"].alias("k"))),
                         F.filter(s["front"], lambda f: (f["r"] > x["r"]) & (f["best"] > best))).cast(entry).alias("front"),
                F.array_append(s["links"], F.struct(best.cast("bigint").alias("best"), p["k"].alias("before"))).cast(link).alias("links"),
                (s["k"] + 1).alias("k")))))

    def begin(front: Column, k: Column) -> Column:
        return F.struct(front.alias("front"), F.array().cast(link).alias("links"), k.alias("k"))

    def chunk(seq: Column):
        def run(s: Column, c: Column) -> Column:
            done = F.aggregate(part(seq, c * CHUNK + 1, F.least(F.lit(CHUNK), F.size(seq) - c * CHUNK)), begin(s["front"], s["k"]), add)
            return let(done, lambda d: F.struct(d["front"].alias("front"), F.concat(s["links"], d["links"]).alias("links"), d["k"].alias("k")))
        return run

    def walk(seq: Column):
        def back(s: Column) -> Column:
            start = F.struct(F.element_at(s["front"], -1)["k"].alias("want"), F.array().cast("array<int>").alias("found"))
            down = F.sequence(F.size(s["links"]) - 1, F.lit(0), F.lit(-1))
            path = F.aggregate(down, start, lambda w, k: F.when(k == w["want"], F.struct(
                F.get(s["links"], k)["before"].alias("want"), F.array_append(w["found"], k).alias("found"))).otherwise(w), lambda w: F.reverse(w["found"]))
            return F.transform(path, lambda k: F.get(seq, k))
        return back

    def chain(seq: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(seq) - 1) / CHUNK).cast("int"))
        folded = F.aggregate(chunks, begin(F.array().cast(entry), F.lit(0)), chunk(seq))
        return F.when(F.size(seq) <= 1, seq).otherwise(let(folded, walk(seq)))
    return let(pieces, chain)


# ---- lines -------------------------------------------------------------------------------------------------------

def lines_of(c) -> Column:
    """The lines of a text; a line end at the end of the text begins no further line."""
    return let(F.split(F.coalesce(col(c), F.lit("")), LINE_END, -1), lambda x: F.when(
        F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def _equal_lines(old: Column, new: Column, old_from: Column, new_from: Column) -> Column:
    """Groups of equal lines of both sides: structs of line, side, number."""
    tagged = F.concat(
        F.transform(old, lambda x, i: F.struct(x.alias("line"), F.lit(0).alias("side"), (i + old_from).alias("no"))),
        F.transform(new, lambda x, i: F.struct(x.alias("line"), F.lit(1).alias("side"), (i + new_from).alias("no"))))
    return blocks(F.sort_array(tagged), lambda x, y: x["line"] != y["line"])


def _longest_chain(pairs: Column) -> Column:
    """Of pairs (i, j) the most that rise on both sides, by i.

    Pairs that follow one another on both sides stand or fall together, so the chain is sought among such pieces.
    """
    def chain(by_i: Column) -> Column:
        by_j = F.sort_array(F.transform(by_i, lambda p, t: F.struct(p["j"].alias("j"), t.alias("t"))))
        pieces = F.sort_array(F.transform(blocks(by_j, lambda x, y: y["t"] != x["t"] + 1), lambda b: F.struct(
            F.get(b, 0)["t"].alias("t"), F.get(b, 0)["j"].alias("r"), F.size(b).alias("w"))))
        return let(heaviest_chain(pieces), lambda kept: F.flatten(F.transform(kept, lambda p: part(by_i, p["t"] + 1, p["w"]))))
    return let(F.sort_array(pairs), chain)


def _pair(i: Column, j: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def _between(pairs: Column, old: Column, new: Column) -> Column:
    """What lies before, between and after pairs of lines: first and last line (o1, o2) of the one side, (n1, n2) of the other."""
    edged = F.concat(F.array(_pair(F.lit(0), F.lit(0))), pairs, F.array(_pair(F.size(old) + 1, F.size(new) + 1)))
    return let(edged, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda g: F.struct(
        (F.get(e, g - 1)["i"] + 1).alias("o1"), (F.get(e, g)["i"] - 1).alias("o2"),
        (F.get(e, g - 1)["j"] + 1).alias("n1"), (F.get(e, g)["j"] - 1).alias("n2"))))


def _once(old: Column, new: Column) -> Column:
    """Pairs of lines that stand once on either side."""
    one = F.lit(1)
    return F.transform(F.filter(_equal_lines(old, new, one, one), lambda g: (F.size(g) == 2) & (F.get(g, 0)["side"] != F.get(g, 1)["side"])),
                       lambda g: _pair(F.get(g, 0)["no"], F.get(g, 1)["no"]))


def _kth(old: Column, new: Column, g: Column) -> Column:
    """Inside a stretch of both sides, pairs of the kth of equal lines with the kth."""
    def pairs(group: Column) -> Column:
        return let(F.filter(group, lambda x: x["side"] == 0), lambda o: let(F.filter(group, lambda x: x["side"] == 1), lambda n: F.transform(
            part(o, F.lit(1), F.least(F.size(o), F.size(n))), lambda x, k: _pair(x["no"], F.get(n, k)["no"]))))
    groups = _equal_lines(part(old, g["o1"], g["o2"] - g["o1"] + 1), part(new, g["n1"], g["n2"] - g["n1"] + 1), g["o1"], g["n1"])
    return F.flatten(F.transform(groups, pairs))


def with_changes(df: DataFrame, old: str, new: str, into: str = "changes") -> DataFrame:
    """Where two arrays of lines differ, in order: lines o1 to o2 give way to lines n1 to n2; an empty side ends before it begins.

    Lines that stand once in both are matched first, then, between two matches, the kth of equal lines with the kth; of
    each as many stay as rise on both sides.  The steps are columns of their own, because the analyzer resolves
    nested lambdas level by level and gives up beyond a hundred.
    """
    o, n = F.col(old), F.col(new)
    both = lambda g: (g["o2"] >= g["o1"]) & (g["n2"] >= g["n1"])
    out = df.withColumn("_once", _once(o, n)).withColumn("_first", settled(_longest_chain(F.col("_once"))))
    out = out.withColumn("_pairs", F.transform(F.filter(_between(F.col("_first"), o, n), both), lambda g: _kth(o, n, g)))
    out = out.withColumn("_common", F.sort_array(F.concat("_first", F.flatten(F.transform("_pairs", _longest_chain)))))
    changed = F.filter(_between(F.col("_common"), o, n), lambda g: (g["o2"] >= g["o1"]) | (g["n2"] >= g["n1"]))
    out = out.withColumn(into, settled(changed))
    return out.drop("_once", "_first", "_pairs", "_common")


def _span(start: Column, n: Column) -> Column:
    return F.when(n == 1, start.cast("string")).otherwise(F.concat_ws(",", F.when(n == 0, start - 1).otherwise(start), n))


def _hunk(o: Column, n: Column, context: int):
    def text(h: Column) -> Column:
        first, last = F.get(h, 0), F.element_at(h, -1)
        lead = F.least(F.lit(context), first["o1"] - 1)
        trail = F.least(F.lit(context), F.size(o) - last["o2"])
        o1, n1 = first["o1"] - lead, first["n1"] - lead
        header = F.concat(F.lit("@@ -"), _span(o1, last["o2"] + trail - o1 + 1), F.lit(" +"), _span(n1, last["n2"] + trail - n1 + 1), F.lit(" @@"))
        sign = lambda s, lines, start, count: F.transform(part(lines, start, count), lambda x: F.concat(F.lit(s), x))
        body = F.flatten(F.transform(h, lambda c, k: F.concat(
            sign("-", o, c["o1"], c["o2"] - c["o1"] + 1), sign("+", n, c["n1"], c["n2"] - c["n1"] + 1),
            sign(" ", o, c["o2"] + 1, F.coalesce(F.get(h, k + 1)["o1"] - c["o2"] - 1, trail)))))
        return F.array_join(F.concat(F.array(header), sign(" ", o, o1, lead), body), "\n")
    return text


def _compared(df: DataFrame, old: str, new: str) -> DataFrame:
    return with_changes(df.withColumns({"_old": settled(lines_of(old)), "_new": settled(lines_of(new))}), "_old", "_new", "_changes")


def unified_diff(df: DataFrame, old: str, new: str, into: str = "diff", context: int = 3) -> DataFrame:
    """DF2, ordered: adds the unified diff of two texts of a row; empty where no line differs, null texts are empty."""
    out = _compared(df, old, new).withColumn("_hunks", blocks(F.col("_changes"), lambda x, y: y["o1"] - x["o2"] - 1 > 2 * context))
    out = out.withColumn("_hunks", F.transform("_hunks", _hunk(F.col("_old"), F.col("_new"), context)))
    text = F.concat(F.lit("--- old\n+++ new\n"), F.array_join("_hunks", "\n"))
    return out.withColumn(into, settled(F.when(F.size("_hunks") == 0, F.lit("")).otherwise(text))).drop("_old", "_new", "_changes", "_hunks")


def edits(df: DataFrame, old: str, new: str, into: str = "edits") -> DataFrame:
    """DF2, ordered: adds the changed lines of two texts: structs of change (removed or added), line number on its side, line."""
    def side(name, lines, a, b):
        return F.transform(part(lines, a, b - a + 1), lambda x, i: F.struct(F.lit(name).alias("change"), (a + i).alias("no"), x.alias("line")))
    changed = F.flatten(F.transform("_changes", lambda c: F.concat(
        side("removed", F.col("_old"), c["o1"], c["o2"]), side("added", F.col("_new"), c["n1"], c["n2"]))))
    return _compared(df, old, new).withColumn(into, settled(changed)).drop("_old", "_new", "_changes")
