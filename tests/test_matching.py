"""Ratios of lines against a plain loop."""
import random
from difflib import SequenceMatcher

import __spark_entry__ as entry
from recordlake.functions import sequences
from recordlake.operators import resolve
from recordlake.plans import matching


def test_matching_ratio_takes_every_line(rows, tmp_path):
    texts = {1: "abc\nabd\n\nxyz", 2: "only", 3: None, 4: "same words\nsame words"}
    rows(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, text in texts.items():
        lines = (text or "").split("\n")
        want |= {(i, n + 1, round(SequenceMatcher(None, a, b).ratio(), 6)) for n, (a, b) in enumerate(zip(lines, lines[1:]))}
        want |= {(i, 1, None)} if len(lines) == 1 else set()
    got = entry.queries()["df1_matching_ratio"](rows([], "x int").sparkSession, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.line, r.ratio) for r in got} == want


def test_points_of_large_keys(rows, tmp_path):
    keys = [-5, 0, 7, 900_000, 900_001, 2 ** 40, None]
    rows([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark = rows([], "x int").sparkSession

    def rest(n, m):         # the sign goes with the number, as in SQL
        return abs(n) % m * (1 if n >= 0 else -1)
    want = sorted((round(43 + rest(k * k * 31, 10007) / 50000, 4), round(2 + rest(k ** 3 * 17 + k * 7, 10009) / 50000, 4))
                  for k in keys if k is not None)
    got = sorted((r.lat, r.lon) for r in matching.points(spark, str(tmp_path)).collect() if r.lat is not None)
    assert got == want
    assert entry.queries()["gr4_farthest"](spark, str(tmp_path)).first().metres > 0


def test_near_pairs_come_once(rows):
    places = [(43 + i * 0.0004, 2 + j * 0.0005) for i in range(12) for j in range(12)]
    pairs = resolve.near_pairs(rows(places * 2, "lat double, lon double"), 150.0).drop("metres").collect()
    assert pairs and len(pairs) == len(set(pairs))


def spellings(seed, n):
    rng = random.Random(seed)
    names = set()
    for _ in range(n):
        base = [rng.choice("abcdefg") for _ in range(rng.randrange(1, 24))]
        names.add("".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(other) + 1)
                other[at:at + rng.randrange(2)] = [rng.choice("abcdefg")] * rng.randrange(3)
            names.add("".join(other))
    return sorted(names)


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def test_spellings_of_all_lengths_meet(rows):
    names = spellings(3, 60)
    for least in (0.85, 0.7):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if ratio(a, b) >= least}
        got = {(r.a, r.b) for r in resolve.similar_spellings(rows([(x,) for x in names], "name string"), least).collect()}
        assert len(want) > 50 and got == want


def test_few_spellings_reach_the_common_subsequence(rows, monkeypatch):
    """Names that merely have the same letters are told apart before letters are compared in order."""
    seen = []
    real = sequences.matching_ratio
    monkeypatch.setattr(resolve.sq, "matching_ratio", lambda a, b: seen.append((a, b)) or real(a, b))
    rng = random.Random(4)
    names = sorted({"abcd" + "".join(rng.choice("bcdfghjk") for _ in range(8)) for _ in range(400)})
    frame = rows([(x,) for x in names], "name string")
    got = {(r.a, r.b) for r in resolve.similar_spellings(frame, 0.85).collect()}
    assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if ratio(a, b) >= 0.85}
    signs = {r.name: r.s for r in frame.select("name", resolve._signs("name").alias("s")).collect()}
    near = sum((signs[a] ^ signs[b]).bit_count() <= 2 for i, a in enumerate(names) for b in names[i + 1:])
    alike = sum(len(set(a) ^ set(b)) <= 2 for i, a in enumerate(names) for b in names[i + 1:])
    assert seen and near * 5 < alike


def test_common_letters_of_long_lines():
    a = "".join(random.Random(1).choice("abcdefgh") for _ in range(700))
    b = a[:200] + a[350:] + "xyz"
    assert sequences._common(a, b) == sequences._common(b, a) == 550
    assert sequences._common("", "abc") == 0 and sequences._common("abc", "abc") == 3 and sequences._common("aXbXc", "abc") == 3
