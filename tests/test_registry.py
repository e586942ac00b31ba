"""Every registered query with a SQL side gives the same rows at the smallest scale."""
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
# A cross-section of the registry; tools/check.py runs all of it.
SAMPLE = ["pf4_blocks", "pf5_split_items", "pf7_sentences", "sg1_votes", "sg5_legal_refs", "sg9_rank_topics", "ag4_finance_summary",
          "ag9_ledger_rollup", "ag10_sales_by_mutation", "ag15_thread_summary", "jn1_similar_pairs", "jn4_confirm_places",
          "jn8_diff_pages", "wn1_eras", "wn5_version_chain", "wn11_pack_batches", "wn13_sliding_count", "pv4_redact",
          "pv7_redact_documents", "pv10_mask_by_vocabulary", "ft3_search", "qc8_validate_rows", "sr1_read_records", "st4_topic_counts"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return db


def plain(rows, order):
    out = [tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return sorted(out)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert plain(df.collect(), [df.columns.index(c) for c in cols]) == plain(
        cur.fetchall(), [names.index(c) for c in cols])


def test_rate_limit_stream_equals_batch(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    q = entry.queries()
    key = lambda name: sorted((r["event_id"], r["wait"]) for r in q[name](spark, FOLDER).collect())
    assert key("st2_rate_limit") == key("st2_rate_limit_batch")
