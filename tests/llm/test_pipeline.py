"""The stages, each against a brute-force version on its own input."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from recordlake.llm import mixing, simhash
from tests.llm.test_lines import _clean
from tests.llm.test_search import _components, _print

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["river", "stone", "walks", "over", "many", "hills,", "then.", "rain", "falls", "upon", "green", "fields"]
    docs = []
    for i in range(240):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(2, 6)))
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 10 == 9:
            text = docs[-2 if (i - 1) % 6 == 0 else -1][1] + "\nsome other end"
        docs.append((i, text, "en", ["a", "b", "c", None][i % 4], len(text)))
    docs += [(300, None, None, None, None), (301, "", "en", "a", 0), (None, "no id\nat all " * 20, "en", "d", 7), (5, docs[5][1], "en", "b", len(docs[5][1]))]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    given = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, given, folder).cache()
        before, after = given.collect(), out.collect()
        if name != "packing":
            assert out.columns == given.columns
        if name == "quality classifier":
            rows = Counter(before)
            assert not Counter(after) - rows
            assert {r.doc_id for r in before if r.text and "###" in r.text}.isdisjoint(r.doc_id for r in after)
            assert {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 240 and "###" not in r.text} <= {r.doc_id for r in after}
        if name == "line dedup":
            want = _clean(sorted({(r.doc_id, r.text) for r in before}, key=str))
            assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, want[r.doc_id]) for r in before)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        if name == "SimHash near-dedup":
            prints = {r.doc_id: _print(r.text) for r in before if r.doc_id is not None}
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(set(_components(prints).values()))
            assert not Counter(after) - Counter(before)
        if name == "mixing sources to target weights":
            assert set(after) <= set(before)
            taken = defaultdict(int)
            for r in after:
                taken[r.doc_id] += len((r.text or "").encode().split())
            assert taken == {r.doc_id: r.taken for r in mixing.report(given).collect() if r.taken or r.doc_id in taken}
            assert max(Counter(after).values()) <= 3
        if name == "packing":
            ids = defaultdict(int)
            for r in after:
                ids[r.doc_id] += r.length
            n = Counter(r.doc_id for r in before)
            assert ids == {r.doc_id: r.doc_tokens * n[r.doc_id] for r in after}
            assert set(ids) == set(n)
        given = out


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
