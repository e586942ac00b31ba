"""Packing, mixing and classifier against plain Python."""
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from recordlake.llm import classifier, mixing, packing
from recordlake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, ids string, __key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- packing ---------------------------------------------------------------------------------------------------

def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "It's THE Straße's end", "a\x1cb \x85c d", "x<|endoftext|>y <|endoftext|> z", "é ́e",
             "ΟΔΟΣ Σ", "don't 12345 #!@ --", "\ttab\r\nline\x0b\x0c", "日本語 テキスト", "İstanbul", "a" * 3000]
    got = packing.WordIds(tokenizer_path())(texts)
    assert [list(g) for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def _best(count, size, window):
    """The level of least sum of squares, by trying every move."""
    best = None
    for level in range(window - size + 1):
        if level and not count[level]:
            continue
        after = count.copy()
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        value = ((after ** 2).sum(), -level)
        if best is None or value < best[0]:
            best = (value, level)
    return best[1]


def test_level_choice_against_brute_force():
    rng = np.random.default_rng(3)
    p = packing.Packer(40, 10 ** 6)
    for doc in range(600):
        size = int(rng.integers(1, 40))
        assert p.best_level(size) == _best(p.count, size, 40)
        list(p.add(doc, np.zeros(size, "<u4")))


@pytest.mark.parametrize("most_open", [3, 10 ** 6])
def test_packer_loses_nothing(most_open):
    rng = np.random.default_rng(5)
    docs = [np.arange(n, dtype="<u4") for n in rng.integers(0, 300, 400)]
    p = packing.Packer(64, most_open)
    sequences = [s for d, ids in enumerate(docs) for s in p.add(d, ids)] + list(p.finish())
    got = defaultdict(list)
    for s in sequences:
        for d, start, ids in s:
            got[d].append((start, list(ids)))
    assert {d: [x for _, part in sorted(v) for x in part] for d, v in got.items()} == {
        d: list(ids) for d, ids in enumerate(docs) if len(ids)}
    assert packing.padding([sum(len(i) for *_, i in s) for s in sequences], 64) == 0
    assert max(sum(len(i) for *_, i in s) for s in sequences) == 64


def test_pack(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "same text", "same text", "w " * 9000, "Ünï — " * 400, *(f"doc {i} " * i for i in range(300))]
    data = [(i, x, "en", "s", "x", 1) for i, x in enumerate(texts)] + [(None, "no id", None, None, None, None), (7, texts[7], "en", "s", "x", 1)]
    pieces = packing.pack(rows(data, DOCS), tokenizer_path()).collect()
    ids_of = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in data}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append((r.start, list(np.frombuffer(r.ids, "<u4"))))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids_of[r.doc_id]) and r.length == len(r.ids) // 4
    twice = by_doc.pop(7)
    assert sum(len(i) for _, i in twice) == 2 * len(ids_of[7])
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in by_doc.items()} == {k: v for k, v in ids_of.items() if k != 7}
    for s in by_sequence.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.padding([sum(n for _, n in s) for s in by_sequence.values()]) == 0
    assert packing.pack(rows([], DOCS), tokenizer_path()).count() == 0
    for r in packing.report(rows(data[2:6], DOCS), tokenizer_path()).collect():
        part = ids_of[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


# ---- mixing ----------------------------------------------------------------------------------------------------

def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        open_w = sum(w[s] for s in names if s not in full)
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * w[s] / open_w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def _mix_data():
    rng = np.random.default_rng(1)
    out = [(i, " ".join(["w"] * int(rng.integers(0, 80))), "en", ["a", "b", "B", "é", None, "a", "a"][i % 7], "x", 1) for i in range(5000)]
    return out + [(9000, "only ## one", "en", "zz", "x", 1), (9001, None, "en", "none", "x", 1), (9002, "", "en", "none", "x", 1),
                  (None, "a b", "en", "a", "x", 1), (3, out[3][1], "en", out[3][3], "x", 1), (9003, "long " * 30000, "en", "é", "x", 1)]


def test_mixing(rows):
    data = _mix_data()
    df = rows(data, DOCS)
    got = mixing.report(df).collect()
    assert len(got) == len(data)
    size_of = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in data:
        sizes[s] += size_of(t)
    want = _targets(sizes)
    source = {i: s for i, _, _, s, *_ in data}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
        epochs = {r.taken // r.size for r in got if source[r.doc_id] == s and r.size}
        assert not epochs or max(epochs) - min(epochs) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(df.repartition(7)).collect()))
    rows_out = mixing.mixed(df)
    assert rows_out.columns == df.columns
    count = defaultdict(int)
    for r in rows_out.collect():
        count[r.doc_id] += size_of(r.text)
    assert {k: v for k, v in count.items() if v} == {
        r.doc_id: sum(x.taken for x in got if x.doc_id == r.doc_id) for r in got if r.taken}
    assert mixing.report(rows([], DOCS)).count() == 0


def test_selection_follows_keys(rows, monkeypatch):
    """Whatever the buckets, a source's documents are taken in the order of their keys."""
    df = rows(_mix_data(), DOCS)
    want = sorted(map(str, mixing.report(df).collect()))
    for n in (1, 50, 10 ** 9):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", n)
        assert sorted(map(str, mixing.report(df).collect())) == want
    keyed = mixing.with_keys(df).select(*mixing.KEYS).cache()
    for s in ("a", "b", None):
        some = [r for r in mixing.apply(keyed, mixing.plan(keyed)).collect() if r["__source"] == s]
        more = [r["__key"] for r in some if r["__times"] > r["__epochs"]]
        less = [r["__key"] for r in some if r["__times"] == r["__epochs"]]
        assert not more or not less or max(more) <= min(less)


# ---- classifier ------------------------------------------------------------------------------------------------

def _classify_data():
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["river", "and", "stone", "walks", "over", "many", "hills,", "then."], 60)) for _ in range(400)]
    bad = [" ".join(f"{w}###" for w in rng.choice(["buy", "now", "win"], 60)) for _ in range(400)]
    return [(i, t, "en", "s", "x", 1) for i, t in enumerate(x for p in zip(good, bad) for x in p)]


def test_classifier(rows):
    data = _classify_data()
    odd = [(5000, None, None, None, None, None), (5001, "", "en", "s", "x", 1), (None, "x", "en", "s", "x", 1), (5002, "v " * 200000, "en", "s", "x", 1)]
    labels = rows([(i, 1 - i % 2) for i in range(800)] + [(5001, None), (None, 1), (3, 1), (2, 7)], "doc_id long, quality int")
    df = rows(data + odd + data[:3], DOCS)
    out = classifier.classify(df, labels).collect()
    assert len(out) == len(data) + len(odd) + 3
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in out if r.held_out and r.doc_id < 800]
    assert len(held) > 100 and all(r.predicted == 1 - r.doc_id % 2 for r in held)
    kept = classifier.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)
    one = classifier.classify(df.limit(3), labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.7
    assert {r.score for r in classifier.classify(df.limit(3), labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(df.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned(rows):
    data = _classify_data()
    right = rows([(i, 1 - i % 2) for i in range(800)], "doc_id long, quality int")
    wrong = rows([(i, i % 2 if zlib.crc32(str(i).encode()) % 4 == 2 else 1 - i % 2) for i in range(800)], "doc_id long, quality int")
    a, b = (sorted((r.doc_id, r.score) for r in classifier.classify(rows(data, DOCS), x).collect()) for x in (right, wrong))
    assert a == b


def test_flat_trees_against_recursion():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    model = classifier.train(x, (x[:, 0] * x[:, 1] > 0).astype(float))

    def walk(t, row, at=0):
        inner = model.feature.shape[1]
        if at >= inner:
            return model.leaf[t, at - inner]
        return walk(t, row, 2 * at + (2 if row[model.feature[t, at]] > model.cut[t, at] else 1))
    want = [model.start + sum(walk(t, r) for t in range(len(model.leaf))) for r in x[:50]]
    assert np.allclose(model.margin(x[:50]), want)
    assert ((model.probability(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.95


def test_mixing_repeated_rows(rows):
    """Half of a source are rows that agree in all: the cut falls among them, and targets are met within a document."""
    data = [(1, "w " * 10, "a")] * 150 + [(2 + i, "w " * (1 + i % 9), "a") for i in range(200)] + [(900, "x " * 7, "b")] * 400 + [(None, None, "b")] * 30
    df = rows(data, "doc_id long, text string, source string").repartition(6)
    got = mixing.report(df).collect()
    assert len(got) == len(data)
    for size, source in ((sum(r[1].count("w ") for r in data if r[2] == "a"), "a"), (2800, "b")):
        mine = [r for r in got if r["source_size"] == size]
        assert len(mine) == sum(d[2] == source for d in data)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(df.repartition(3)).collect()))
    assert mixing.mixed(df).count() == sum(r["taken"] // r["size"] for r in got if r["size"]) + mixing.mixed(df).where("doc_id IS NULL").count()


def test_mixed_with_names_of_its_own(rows):
    """Columns named like those the operator adds come through as they are."""
    names = "doc_id long, text string, source string, target string, source_size int, __times int, size double"
    data = [(i, "w " * (i % 7), "ab"[i % 2], f"t{i}", i, -i, i / 2) for i in range(60)]
    out = mixing.mixed(rows(data, names))
    assert out.columns == [c.split()[0] for c in names.split(", ")]
    assert {tuple(r) for r in out.collect()} <= set(data) and out.count() > 0
