"""Top-k search and SimHash near-duplicates against brute force."""
import math

import numpy as np
import pytest
import xxhash

from recordlake.llm import simhash, topk


# ---- top-k -----------------------------------------------------------------------------------------------------

def _brute_top(vectors, every, k):
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, w) in enumerate(ints):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for m, (i, v) in enumerate(ints) if m != n and len(v) == len(w))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_top_k(rows, k, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "BINS", 16)
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    data += [(1000 + i, data[50][1]) for i in range(150)]                    # a hot vector, ties
    data += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] + [0.0] * 7), (2150, [float("inf")] * 8), (None, [1.0] * 8),
             (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, []), (2251, []), (50, data[50][1]), (2300, [0.0] * 8), (-50, [-0.001] * 8)]
    df = rows([(i, v, 1, 2.0) for i, v in data], "vec_id long, embedding array<float>, label int, score double")
    got = sorted(map(tuple, topk.search(df, 50, k).collect()))
    assert got == _brute_top(data, 50, k)
    twice = [(7, [5.0, 0.0]), (7, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [3.0, 0.0]), (8, [2.0, 0.0])]
    again = rows(twice, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(again, 50, k).collect())) == _brute_top(twice, 50, k)
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id = 51")).count() == 0


def test_top_k_large_components(rows):
    data = [(i, [float(np.float32(1e5 * (i + 1))), 3.0, -7e4]) for i in range(0, 8)]
    df = rows(data, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, 2, 3).collect())) == _brute_top(data, 2, 3)
    assert topk._scores(np.array([[3 * 10 ** 9, 1]]), np.array([[3 * 10 ** 9, 1]])).tolist() == [[topk.LIMIT]]
    assert topk._scores(np.array([[10 ** 9, 1]]), np.array([[10 ** 9, 1]])).tolist() == [[10 ** 18 + 1]]


# ---- SimHash ---------------------------------------------------------------------------------------------------

def _print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def _near(rng, center, n, flips):
    out = []
    for _ in range(n):
        p = center
        for b in rng.choice(64, flips, replace=False):
            p ^= 1 << int(b)
        out.append(p)
    return out


def _prints():
    rng = np.random.default_rng(11)
    out = [int(x) for x in rng.integers(0, 2 ** 64, 900, dtype=np.uint64)]
    for p in out[:60]:
        out += _near(rng, p, 2, 3) + _near(rng, p, 1, 4)
    return out + _near(rng, 5, 250, 2) + _near(rng, 2 ** 63 + 9, 150, 4) + [0, 0, 2 ** 64 - 1]


@pytest.mark.parametrize("shard_rows,sample", [(16384, 50_000), (40, 50_000), (60, 100)])
def test_components_of_fingerprints(spark, monkeypatch, shard_rows, sample):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    prints = dict(enumerate(_prints()))
    df = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in prints.items()], "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.group(df).collect()}
    assert got == _components(prints)


def test_trees_lose_no_pair():
    prints = np.unique(np.array(_prints(), np.uint64))
    tree = simhash.build(prints, 50)
    leaves = [set(p.tolist()) for _, p in simhash.route(tree, prints)]
    for i, a in enumerate(prints.tolist()):
        for b in prints[np.bitwise_count(prints ^ np.uint64(a)) <= 3].tolist():
            assert any(a in s and b in s for s in leaves)


def test_near_duplicates(rows):
    base = " ".join(f"word{i % 97} other{i}" for i in range(400))
    texts = [base, base.upper(), base + " tail", None, "", "  \n", "Two words", "two WORDS", "É x y", "é x y", "long " * 50_000,
             "one", "a b c d e f g h", base.replace("other7 ", "another ")]
    data = [(i + 10, t, "en", i, 0) for i, t in enumerate(texts)] + [(None, "alone", "en", 1, 0), (None, base, "en", 1, 0), (10, base, "en", 0, 0),
                                                                     (None, "alone", "fr", 1, 0)]
    df = rows(data, "doc_id long, text string, fingerprint string, component_id int, __mark int")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(data)
    prints = {i: _print(t) for i, t, *_ in data if i is not None}
    want = _components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out if r.doc_id is not None} == {
        (i, f"{prints[i]:016x}", want[i]) for i in prints}
    assert sorted((r.component_id or -1) for r in out if r.doc_id is None) == [-1, -1, 10]
    df = df.drop("__mark")
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, *set(want.values())])
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.first_of_each(df.limit(0)).count() == 0


def test_first_of_each_keeps_one_row_for_each_component(rows):
    """Components without ids, or with the same id, are told apart."""
    def text(n):
        return " ".join(f"w{n}x{i}" for i in range(40))
    data = [(None, text(0), 1), (None, text(0), 1), (None, text(1), 2), (None, text(2), 3), (7, text(3), 4), (7, text(4), 5), (8, text(4), 6), (9, text(2), 7)]
    got = simhash.first_of_each(rows(data, "doc_id long, text string, n int")).collect()
    assert sorted(r.n for r in got) == [1, 2, 4, 5, 7]
