"""Sharding and quality rules against plain Python."""
import hashlib
import math
import re
import zlib

from recordlake.llm import rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n", "one", "a b c a b c a b", "x y\nx y\n\nx y", "a b c d a b c", "w " * 60,
         "Straße — été x # $ 5 < 6", "\na  b\n", "\v\f a\vb", "k l m " * 3000 + "end",
         " ".join(f"{chr(97 + i % 26)}o{chr(97 + i // 26)}r" for i in range(80)), "a a a", "a a", "#### $$$$ " * 40]


def _expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_measures(rows):
    df = rows([(i, t, "en", "x") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None)] * 2,
              "doc_id long, text string, n_words string, kept string")
    out = rules.judge(df).collect()
    assert len(out) == len(TEXTS) + 2
    got = {r.doc_id: tuple(r)[1:7] for r in out}
    for i, t in enumerate(TEXTS):
        assert got[i] == _expected(t), t
    assert [r.kept for r in out if r.doc_id == 12] == [True]
    assert not any(r.kept for r in out if r.base_failed)


def test_cascade_order_changes_nothing(rows):
    df = rows([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    m = rules.measure(df)
    kept = [{(r.doc_id, r.k) for r in m.select("doc_id", rules.cascade(list(o)).alias("k")).collect()}
            for o in (rules.RULES, rules.RULES[::-1])]
    assert kept[0] == kept[1]


def test_order_by_yield():
    a, b, c = rules.RULES[:3]
    said = [{a.name: True, b.name: True, c.name: False}] * 9 + [{a.name: False, b.name: False, c.name: True}]
    cost = {a.name: 1.0, b.name: 0.5, c.name: 1.0}
    assert rules.order_by_yield((a, b, c), said, cost) == [b, c, a]     # a rejects nothing that b passes


def test_rules_empty(rows):
    assert rules.judge(rows([], "doc_id long, text string")).count() == 0


def _descend(key, tree):
    names, at = [{}, {}, {}], ()
    for region, rack, shard, w in tree:
        path = (region, rack, str(shard))
        for d in range(3):
            names[d][path[:d + 1]] = names[d].get(path[:d + 1], 0) + w
    for d in range(3):
        def wait(path):
            u = (int(hashlib.md5(f"{key}/{'/'.join(path)}".encode()).hexdigest()[:13], 16) + .5) / 16 ** 13
            return -math.log(u) / names[d][path]
        at = min((p for p in names[d] if p[:d] == at and names[d][p] > 0), key=wait)
    return int(at[2])


def test_descent_weights_and_growth(rows, spark):
    docs = spark.range(3000).withColumnRenamed("id", "doc_id")
    tree = [("a", "p", 0, 1.0), ("a", "p", 1, 3.0), ("a", "q", 2, 2.0), ("b", "r", 3, 2.0), ("b", "r", 4, 0.0)]
    got = {r.doc_id: r.shard for r in sharding.assign(docs, tree).collect()}
    assert got == {k: _descend(k, tree) for k in got}
    share = [sum(s == x for s in got.values()) / 3000 for x in range(5)]
    assert share[4] == 0 and all(abs(p - w / 8) < .04 for p, w in zip(share, (1, 3, 2, 2)))
    heavier = {r.doc_id: r.shard for r in sharding.assign(docs, [*tree[:3], ("b", "r", 3, 4.0), tree[4]]).collect()}
    assert all(s == got[k] or s == 3 for k, s in heavier.items())       # only into the grown subtree
    for n in (5, 24, 25, 30):
        was = {r.doc_id: r.shard for r in sharding.assign(docs, sharding.standard_tree(n)).collect()}
        now = {r.doc_id: r.shard for r in sharding.assign(docs, sharding.standard_tree(n + 1)).collect()}
        assert n < 24 or all(s == was[k] or s == n for k, s in now.items())


def test_manifest(rows):
    data = [(i % 500, t, "x", 1) for i, t in enumerate(TEXTS * 50)] + [(None, None, None, None)]
    out = sharding.manifest(rows(data, "doc_id long, text string, shard string, slot int")).collect()
    assert len(out) == len(data)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in data}
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in out}) == len({r.doc_id for r in out})
    assert sharding.manifest(rows([], "doc_id long, text string")).count() == 0
