"""The streams over tables split into several files and batches give what they give over one file, in and out of order."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recordlake.streaming import jobs
from recordlake.streaming.state import BucketTable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Ten part files in order of time, so two batches."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    path = str(tmp_path_factory.mktemp("split"))
    os.symlink(f"{FOLDER}/customer.parquet", f"{path}/customer.parquet")
    for name, order in (("events", ["ts", "event_id"]), ("documents", ["doc_id"])):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartitionByRange(10, *order).write.parquet(f"{path}/{name}.parquet")
        parts = sorted(f for f in os.listdir(f"{path}/{name}.parquet") if f.startswith("part-"))
        assert len(parts) == 10
        for i, f in enumerate(parts):
            os.utime(f"{path}/{name}.parquet/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return path


@pytest.mark.parametrize("name", ["st1_ingest_versions", "st2_rate_limit", "st3_watch_new", "st4_topic_counts", "st5_result_cache"])
def test_split_table(name, spark, split):
    query = entry.queries()[name]
    want = sorted(map(str, query(spark, FOLDER).collect()))
    assert want and sorted(map(str, query(spark, split).collect())) == want


@pytest.fixture
def shuffled(spark, tmp_path):
    """Hits of three clients over twelve days in four files, the newest first; one file a batch."""
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.randrange(3), i, start + dt.timedelta(seconds=rng.randrange(12 * 86400)), rng.choice("ab")) for i in range(200)]
    data.sort(key=lambda r: r[2], reverse=True)
    src, schema = str(tmp_path / "src"), "u bigint, i bigint, ts timestamp, kind string"
    for k in range(4):
        spark.createDataFrame(data[50 * k:50 * k + 50], schema).coalesce(1).write.mode("append").parquet(src)
    return data, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path)


def test_no_hit_is_lost(spark, shuffled):
    data, stream, path = shuffled
    out = jobs.run_to_table(jobs.rate_limit(stream(), "u", "ts", "i", 2, 3600.0), path + "/out", path + "/cp")
    assert sorted(r["i"] for r in out.collect()) == sorted(r[1] for r in data)


def test_late_hits_count_the_window_before_them():
    waits, kept = jobs._admit([100.0, 110.0, 120.0], [], 2, 60.0, 600.0)
    assert waits == [0, 0, 41] and kept == [100.0, 110.0]
    waits, kept = jobs._admit([300.0], kept, 2, 60.0, 600.0)
    assert waits == [0] and kept == [100.0, 110.0, 300.0]
    # two at 100 and 110 stand before 130; nothing before 50 does
    assert jobs._admit([130.0], list(kept), 2, 60.0, 600.0)[0] == [31]
    assert jobs._admit([50.0], list(kept), 2, 60.0, 600.0) == ([0], [50.0, 100.0, 110.0, 300.0])
    assert jobs._admit([2000.0], kept, 2, 60.0, 600.0)[1] == [2000.0]


def test_every_row_is_counted(spark, shuffled):
    data, stream, path = shuffled
    jobs.topic_counts(stream(), path + "/counts", path + "/cp", "ts", "kind").awaitTermination()
    got = {(str(r["start"].date()), r["kind"]): r["n"] for r in jobs.topic_table(spark, path + "/counts", "kind").collect()}
    want = {}
    for _, _, ts, kind in data:
        want[str(ts.date()), kind] = want.get((str(ts.date()), kind), 0) + 1
    assert got == want


def test_first_sighting_once_for_ever(spark, shuffled):
    data, stream, path = shuffled
    known = spark.createDataFrame([(1,)], "u bigint")
    out = jobs.run_to_table(jobs.watch_new(stream(), known, "u", F.col("kind") == "a"), path + "/out", path + "/cp")
    assert sorted(r["u"] for r in out.collect()) == [0, 2]


def test_bucket_table(spark, tmp_path):
    """A batch reads and writes the buckets of its keys only; one that is run again starts from the state before it."""
    t = BucketTable(spark, str(tmp_path / "t"), "k bigint, v string", ["k"], 8)
    frame = lambda pairs: spark.createDataFrame(pairs, "k bigint, v string")
    assert t.rows().count() == 0

    def put(batch, pairs):
        rows = frame(pairs)
        touched = t.touched(rows)
        old = t.read(t.before(batch), touched)
        t.replace(batch, rows.unionByName(old.join(rows.select("k"), "k", "left_anti")), touched)
        return touched

    put(0, [(k, "first") for k in range(40)])
    touched = put(1, [(3, "second")])
    assert len(touched) == 1
    before = t.before(1)
    assert all(before[b] == 0 for b in before) and t.before()[touched[0]] == 1
    assert all(t.before()[b] == 0 for b in before if b != touched[0])
    put(1, [(3, "again")])
    got = {r["k"]: r["v"] for r in t.rows().collect()}
    assert got == {k: "again" if k == 3 else "first" for k in range(40)}
    for batch in range(2, 6):
        put(batch, [(3, str(batch)), (4, str(batch))])
    got = {r["k"]: r["v"] for r in t.rows().collect()}
    assert got[3] == got[4] == "5" and len(got) == 40
    kept = [b for b in range(1, 4) if any(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path / "t" / f"batch={b}") for f in fs)]
    assert kept == []


def test_read_bytes_do_not_grow_with_the_log(spark, tmp_path):
    """Versions of the same keys, batch after batch: the state stays as large as the keys."""
    src, schema = str(tmp_path / "src"), "u bigint, i bigint, ts timestamp, sha string"
    sizes = []
    for part in range(4):
        rows = [(u, 100 * part + u, dt.datetime(2024, 1, 1 + part, 0, u), f"{part}") for u in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.ingest_versions(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), "u", ["ts", "i"], "sha",
                             F.date_trunc("day", F.col("ts"))).awaitTermination()
        state = BucketTable(spark, str(tmp_path / "out/current"), "u bigint, sha string, version bigint", ["u"])
        sizes.append(state.rows().count())
        assert {(r["sha"], r["version"]) for r in state.rows().collect()} == {(f"{part}", part + 1)}
    assert sizes == [20] * 4 and spark.read.parquet(str(tmp_path / "out/versions")).count() == 80
