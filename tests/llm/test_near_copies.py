"""Near copies by Jaccard similarity against brute force."""
import random

import pytest

import corpus_pipeline as pipeline
from recordlake.llm import near_copies, simhash


def _grams(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(docs):
    """The ids that stay where every group of similar texts keeps its smallest."""
    root = {i: i for i, _ in docs}
    grams = {i: _grams(t) for i, t in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, _ in docs:
        for j, _ in docs:
            if i < j and (grams[i] == grams[j] or 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted({find(i) for i in root})


def _documents():
    rng = random.Random(3)
    docs = []
    for base in range(30):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(3000)}"
            docs.append(" ".join(copy))
    docs += ["a few words", "a few words", "a few other", "", "x " * 40, "x " * 90, "b c d e f g h i j", "b c d e f g h i k"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("most", [20, 0])
def test_against_brute_force(rows, most, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS_A_NODE", most)
    docs = _documents()
    got = near_copies.first_of_each(rows([(i, t, 1) for i, t in docs], "doc_id long, text string, n int"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(r.doc_id for r in got.collect()) == _kept(docs)
    assert near_copies.first_of_each(rows([], "doc_id long, text string")).count() == 0


def test_stage_takes_near_copies_that_fingerprints_miss(rows, spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    other = list(words)
    for at in range(20, 300, 60):
        other[at] = "changed"
    texts = [" ".join(words), " ".join(other)]
    prints = [simhash.fingerprint_of(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() > simhash.REACH
    out = pipeline.one_of_each_group(spark, rows(list(enumerate(texts)), "doc_id long, text string"), "")
    assert [r.doc_id for r in out.collect()] == [0]
