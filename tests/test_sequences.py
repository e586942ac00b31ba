"""Common subsequences and ordered differences against plain loops."""
import random
from difflib import unified_diff as library_diff

import pytest
from pyspark.sql import functions as F

from recordlake.functions import sequences as sq
from recordlake.session import cut_lineage


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_matching_ratio(rows):
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("a" * 62, "a" * 62), ("a" * 63, "a" * 63), ("ab" * 90, "ba" * 95), ("é𝒳ß", "𝒳ß\n"), ("x\ny", "\n")]
    for _ in range(150):
        s = lambda: "".join(rng.choice("abcdé𝒳") for _ in range(rng.choice([3, 12, 61, 62, 63, 130, 190])))
        a = s()
        b = s() if rng.random() < .5 else "".join(c for c in a if rng.random() < .8)
        pairs.append((a, b))
    df = rows([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "x")], "i int, a string, b string")
    got = {r["i"]: (r["ab"], r["ba"]) for r in df.select("i", sq.matching_ratio("a", "b").alias("ab"), sq.matching_ratio("b", "a").alias("ba")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert got[i] == (pytest.approx(want), pytest.approx(want))
    assert got[-1] == (None, None)


def plain_chain(pairs):
    """The longest chain, of equal ones the one that ends latest, by dynamic programming."""
    pairs = sorted(pairs)
    best, before = [], []
    for k, (i, j) in enumerate(pairs):
        b, p = max(((best[m], m) for m in range(k) if pairs[m][1] < j), default=(0, -1))
        best.append(b + 1)
        before.append(p)
    if not best:
        return []
    k = max(range(len(best)), key=lambda m: (best[m], m))
    out = []
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def plain_changes(old, new):
    once = [(old.index(x) + 1, new.index(x) + 1) for x in set(old) if old.count(x) == 1 and new.count(x) == 1]
    first = plain_chain(once)
    edged = [(0, 0), *first, (len(old) + 1, len(new) + 1)]
    every = list(first)
    for (i, j), (k, m) in zip(edged, edged[1:]):
        pairs = []
        for x in set(old[i:k - 1]):
            a = [p for p in range(i + 1, k) if old[p - 1] == x]
            b = [p for p in range(j + 1, m) if new[p - 1] == x]
            pairs += list(zip(a, b))
        every += plain_chain(pairs)
    edged = [(0, 0), *sorted(every), (len(old) + 1, len(new) + 1)]
    return [(i + 1, k - 1, j + 1, m - 1) for (i, j), (k, m) in zip(edged, edged[1:]) if k > i + 1 or m > j + 1]


def test_changes(rows):
    rng = random.Random(9)
    cases = [([], []), (["a"], []), ([], ["a", "b"]), (list("abcdef"), list("fabcde")), (list("abc") * 4, list("cab") * 4)]
    for _ in range(250):
        letters = [str(k) for k in range(rng.choice([2, 5, 40]))]
        old = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(new))
            what = rng.random()
            if what < .3:
                new[at:at] = [rng.choice(letters)]
            elif what < .6:
                del new[at:at + 2]
            else:
                part = new[at:at + 5]
                del new[at:at + 5]
                to = rng.randint(0, len(new))
                new[to:to] = part
        if rng.random() < .2:
            rng.shuffle(new)
        cases.append((old, new))
    df = rows([(i, o, n) for i, (o, n) in enumerate(cases)], "i int, o array<string>, n array<string>")
    for r in sq.with_changes(df, "o", "n", "c").collect():
        assert [(c["o1"], c["o2"], c["n1"], c["n2"]) for c in r["c"]] == plain_changes(*cases[r["i"]])


def test_unified_diff(rows):
    """Equal to the standard library's where lines are told apart, and always a diff that leads from one text to the other."""
    rng = random.Random(1)
    cases = [(None, None), (None, "a"), ("a\n", "a"), ("", "\n"), ("a\r\nb\x0bc d", "a\nb\nx\nd"), ("a\nb", "a\nc")]
    for _ in range(120):
        old = [f"line {k}" for k in range(rng.randint(0, 60))]
        new = [x + " changed" if rng.random() < .1 else x for x in old if rng.random() > .07]
        for _ in range(rng.randint(0, 2)):
            new.insert(rng.randint(0, len(new)), f"new {rng.random()}")
        cases.append(("\n".join(old), "\n".join(new)))
    df = rows([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    for r in sq.edits(sq.unified_diff(df, "a", "b", "d"), "a", "b", "e").collect():
        a, b = ((x or "").splitlines() for x in cases[r["i"]])
        assert r["d"] == "\n".join(library_diff(a, b, "old", "new", n=3, lineterm="")), (a, b)
        gone = {e["no"] for e in r["e"] if e["change"] == "removed"}
        came = {e["no"] for e in r["e"] if e["change"] == "added"}
        assert [x for k, x in enumerate(a, 1) if k not in gone] == [x for k, x in enumerate(b, 1) if k not in came]


COUNT = int(__import__('os').environ.get('COUNT', 1000000))


def test_a_million_lines(spark):
    """One text of a million lines: every hundredth changed, one moved from the top to the end, many equal ones."""
    numbers = F.sequence(F.lit(1), F.lit(COUNT))
    line = lambda k: F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("line "), k.cast("string")))
    old = F.transform(numbers, line)
    new = F.concat(F.transform(F.slice(numbers, 2, COUNT - 1), lambda k: F.when(k % 100 == 1, F.concat(line(k), F.lit("!"))).otherwise(line(k))), F.array(F.lit("line 1")))
    df = spark.range(1).select(F.array_join(old, "\n").alias("old"), F.array_join(new, "\n").alias("new"))
    df = cut_lineage(df)            # a constant would be worked out again wherever it is named
    got = sq.edits(df, "old", "new").select(F.inline("edits")).groupBy("change").count()
    assert {r["change"]: r["count"] for r in got.collect()} == {"removed": COUNT // 100, "added": COUNT // 100}
