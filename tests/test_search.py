"""The stored index against the plain search: segments, blocks, bounds."""
import random

import pytest
from pyspark.sql import functions as F

from recordlake.operators import search as se


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"mot{i}" for i in range(30)] + ["canal", "canaux", "école", "pont"]
    data = [(rng.choice(["item", "summary"]), str(i), rng.choice(["fr", "en"]), "", " ".join(rng.choices(words, k=rng.choice([3, 8, 40, 200])))) for i in range(400)]
    rows = spark.createDataFrame(data, "kind string, ref string, lang string, title string, body string")
    path = str(tmp_path_factory.mktemp("index"))
    se.BLOCK_DOCS, before = 20, se.BLOCK_DOCS
    for low, high in ((0, 150), (150, 160), (160, 400)):
        se.store_index(rows.where(f"int(ref) >= {low} AND int(ref) < {high}"), path)
    se.BLOCK_DOCS = before
    return rows, path


@pytest.mark.parametrize("q", ["pont", "mot1", "ecole can", "mot2 mot3 pont", "nothing", "", "pont nothing"])
@pytest.mark.parametrize("limit,lang", [(5, None), (1000, "fr")])
def test_same_rows_as_a_plain_search(spark, stored, q, limit, lang):
    rows, path = stored
    want = [tuple(r) for r in se.search(se.build_index(rows), se.corpus_size(rows), q, limit, lang).collect()]
    got, _ = se.search_stored(spark, path, q, limit, lang, width=3)
    assert [tuple(r) for r in got.collect()] == want


def test_few_results_read_few_postings(spark, stored):
    _, path = stored
    few, read = se.search_stored(spark, path, "pont canal", 3, width=2)
    _, every = se.search_stored(spark, path, "pont canal", 1000, width=2)
    assert few.count() == 3 and 0 < read < every


def test_segments_are_left_as_they_are(spark, stored):
    rows, path = stored
    postings, size = se.stored_index(spark, path)
    assert size.first()["n_docs"] == 400 and {r[0] for r in postings.select("segment").distinct().collect()} == {0, 1, 2}
    assert [tuple(r) for r in se.search(postings, size, "pont", 4).collect()] == [
        tuple(r) for r in se.search(se.build_index(rows), se.corpus_size(rows), "pont", 4).collect()]


def test_postings_are_shuffled_once_and_rows_of_one_name_meet(spark):
    data = [("item", "1", "fr", "", "pont canal pont"), ("item", "1", "fr", "", "pont mot mot"), ("item", "2", None, None, "Écluse"),
            ("item", None, "fr", "", "pont"), ("summary", "3", "fr", "", ""), ("summary", "4", "fr", None, None)]
    rows = spark.createDataFrame(data, "kind string, ref string, lang string, title string, body string")
    dealt = se._dealt_postings(rows, F.col("doc_len") % 2, F.pmod(F.xxhash64("kind", "ref"), F.lit(3)))
    names = ["term", "kind", "ref", "lang", "doc_len", "tf"]
    as_set = lambda df: sorted(map(repr, df.select(names).collect()))
    assert as_set(dealt) == as_set(se.build_index(rows))
    assert dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
