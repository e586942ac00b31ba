"""Periodic runs against a plain search for every period."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from recordlake.llm import periods, queries


def plain_runs(w, least):
    """Every maximal stretch whose smallest period is q, for all q."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e + q - i
            if length >= max(least, 2 * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(docs, least):
    """(start, length, period) of each document."""
    text, bounds = periods.numbered([[x.encode() for x in d] for d in docs])
    start, length, period = periods.find(text, bounds, least)
    doc = np.searchsorted(bounds, start, "right") - 1
    out = [[] for _ in docs]
    for d, s, n, p in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[d].append((s - int(bounds[d]), n, p))
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_against_a_plain_search(least):
    rng = random.Random(least)
    docs = [[], ["x"], ["x"] * 50, fibonacci(120), thue_morse(90), list("abcd") * 9 + list("ab") * 8, list("abcabcab") * 3 + ["q"] + list("bcabc") * 5]
    for _ in range(150):
        letters = "abcdefgh"[:rng.randint(1, 8)]
        d = [rng.choice(letters) for _ in range(rng.randint(0, 45))]
        if rng.random() < 0.6:
            root = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
            at = rng.randint(0, len(d))
            d[at:at] = (root * 5)[:rng.randint(len(root), 5 * len(root))]
        docs.append(d)
    rng.shuffle(docs)
    assert found(docs, least) == [plain_runs(d, least) for d in docs]


def test_lyndon_lengths():
    """The longest Lyndon word at each position, against its definition."""
    rng = random.Random(7)
    for _ in range(200):
        parts = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [0]
        for p in parts:
            text += [*p, 0]
        want = [0] * len(text)
        for i in range(len(text)):
            e = i
            while text[e]:
                e += 1
            for k in range(1, e - i + 1):
                u = text[i:i + k]
                if all(u < u[c:] for c in range(1, k)):
                    want[i] = k
        assert periods.lyndon_lengths(np.array(text)).tolist() == want


def test_long_and_odd_rows(rows, monkeypatch):
    monkeypatch.setattr(periods, "SLICE_WORDS", 100)
    long = " ".join(["w%d" % (i % 700) for i in range(4000)])
    texts = [None, "", " \n\t ", "one", long, "a  b\na\tb " * 6, "é ü " * 7 + "ß", "x y " * 6, "x y " * 6]
    df = rows([(i if i != 3 else None, t, 1, "r") for i, t in enumerate(texts)] + [(1, "", 1, "r")], "doc_id int, text string, n_words int, runs string")
    out = periods.collapse(df).collect()
    assert len(out) == len(texts) + 1
    got = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        w = (t or "").split()
        r = got[i if i != 3 else None]
        want = [(0, 4000, 700)] if t == long else plain_runs(w, 12)
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == plain_collapse(w, want)
    assert periods.collapse(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in queries.op13(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(out) == len(docs)
    some = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        w = [x.decode() for x in words]
        want = plain_runs(w, 12)
        some += bool(want)
        r = out[d["doc_id"]]
        assert r["n_runs"] == len(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(w, want).encode()).hexdigest()
    assert some > 5
