"""Line deduplication against brute force."""
import random

import pytest

from recordlake.llm import line_dedup


def _edits(a, b):
    """Word edit distance by dynamic programming; by length where there is one word only."""
    if len(a) > 1000 and len(set(a) | set(b)) == 1:
        return abs(len(a) - len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _clean(docs):
    lines = []
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            words = line.encode().split()
            if words:
                lines.append(((i is None, i or 0), n, words))
    lines.sort(key=lambda x: x[:2])
    gone, earlier = set(), []
    for doc, n, words in lines:
        if any(words == w or len(w) >= 10 and len(words) >= 10 and abs(len(w) - len(words)) < 2 and _edits(w, words) <= 1 for w in earlier):
            gone.add((doc, n))
        earlier.append(words)
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if ((i is None, i or 0), n) not in gone) for i, t in docs}


def _documents():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "Ünï", "dd", "e,", "|"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 16))] for _ in range(25)]
    docs = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 1)] = [rng.choice([*vocabulary, "new"])] * rng.randint(0, 1)
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        docs.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    template = "the user number {} has come in and gone out again today"
    docs += [(200 + i, template.format(i) + "\nshort line") for i in range(60)]
    return docs + [(400, None), (401, ""), (402, " \n\t\n"), (None, "short line\nlast of all"), (403, "x " * 40_000), (404, "x " * 40_001 + "\nq"),
                   (405, "w w w w w w w w w w"), (406, "w w w w w w w w w w w"), (407, "w w w w w w w w w")]


def test_lines_against_brute_force(rows):
    docs = _documents()
    df = rows([(*d, "en", 5, 1, 2) for d in docs], "doc_id long, text string, lang string, n_lines int, mark int, rank int")
    out = line_dedup.clean(df)
    assert set(out.columns) == set(df.columns) | {"n_kept"}
    got = out.collect()
    want = _clean(docs)
    assert len(got) == len(docs)
    for r in got:
        assert r.text == want[r.doc_id], (r.doc_id, r.text, want[r.doc_id])
        assert r.n_kept == (0 if r.text is None else r.text.count("\n") + 1) or r.text == ""
    assert [r.text for r in got if 200 < (r.doc_id or 0) < 260] == [""] * 59


def test_repeated_rows_and_nulls(rows):
    df = rows([(1, "a b\nc"), (1, "a b\nc"), (1, "c\nd"), (None, None), (None, "c"), (None, "e"), (None, "e")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.clean(df).collect()), key=str)
    one = [t for i, t in got if i == 1]
    assert one.count("a b\nc") + one.count("a b") == 2 and sum(t.count("c") for t in set(one)) == 1
    assert sorted(str(t) for i, t in got if i == 0) == ["", "None", "e", "e"]
    assert line_dedup.clean(df.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,near", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a c", "a b c", True),
                                      ("a b c", "c b a", False), ("", "a", True), ("a b", "b a", False), ("a b c d", "a b", False)])
def test_within_one_edit(a, b, near):
    assert line_dedup.within_one_edit(a.split(), b.split()) == near == (_edits(a.split(), b.split()) <= 1)


def test_half_keys_meet():
    rng = random.Random(9)
    for _ in range(500):
        a = [bytes([rng.randrange(97, 100)]) for _ in range(rng.randint(10, 23))]
        b = list(a)
        at = rng.randrange(len(b))
        b[at:at + rng.randint(0, 1)] = [b"z"] * rng.randint(0, 1)
        (af, ab), (bf, bb) = line_dedup.half_keys(a), line_dedup.half_keys(b)
        assert set(af) & set(bf) or set(ab) & set(bb)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)"])
def test_ids_of_any_type(kind, rows):
    """The same lines stay whatever the type of the ids, as long as their order is the same."""
    docs = [d for d in _documents() if d[0] is None or d[0] < 260]
    df = rows(docs, "doc_id long, text string")
    name = "lpad(doc_id, 5, '0')" if kind == "string" else f"cast(doc_id AS {kind})"
    want = _clean(docs)
    got = line_dedup.clean(df.selectExpr(f"{name} AS doc_id", "text")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["text"] == want[None if r["doc_id"] is None else int(r["doc_id"])]
