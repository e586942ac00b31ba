"""WARC archives: an exact round trip, with magic inside payloads and splits anywhere."""
import hashlib
from collections import defaultdict

import pytest

from recordlake.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
LONG = "<p>long é</p>" * 200
PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/\r\n4", LONG), (5, "u", LONG), (9, "u", LONG),
         (9, "u", LONG), (6, "u", FAKE), (7, "u", "x" + FAKE + FAKE + FAKE + "y" * 2000), (8, "u", "x" + FAKE * 3 + "y" * 2000),
         (10, "u", "WARC/1.0\r\n"), (11, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (12, "u", "WARC/1.0\r\n" * 50),
         (None, "u", LONG), (None, None, None), (13, "u", "small"), (14, "u", "small"), (15, "u", "Z" * 300_000 + "WARC/1.0\r\nA: b\r\n\r\n"),
         (16, "u", "q" * 999), (17, "u", "q" * 999), (18, "u", "q" * 1000), (-19, "u", "q" * 1000)]


def _expected(pages):
    best = defaultdict(list)
    for i, _, h in pages:
        best[h or ""].append(i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        ids = best[h or ""]
        top = max((x for x in ids if x is not None), default=None)
        revisit = len(raw) >= 1000 and len(ids) > 1 and i != top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "30011b"])
def test_round_trip(rows, spark, split):
    pages = PAGES + [(100 + i, "u", f"<p>{i}</p>" * (i % 50) + ("WARC/1.0\r\n" if i % 7 == 0 else "")) for i in range(300)]
    df = rows([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, n int").coalesce(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got), key=str) == _expected(pages)


def test_archives_as_text(rows, spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(rows(PAGES, "page_id long, url string, html string").coalesce(1), path, records=5)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) == -(-len(PAGES) // 5)
    raw = files[0].read_bytes()
    assert raw.startswith(b"WARC/1.0\r\n") and raw.endswith(b"\r\n\r\n")
    urls = {r.page_id: r.url for r in warc.read_archives(spark, path).collect()}
    assert urls[4] == "http://a/%0D%0A4" and urls[3] is None and 666 not in urls


def test_empty(rows):
    assert warc.round_trip(rows([], "page_id long, url string, html string")).count() == 0


def test_broken_archives(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    for name, raw in (("a", b"junk" + good), ("b", good + b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + good), ("c", good + b"??" + good), ("d", b"")):
        (tmp_path / name).write_bytes(raw)
    assert warc.read_archives(spark, str(tmp_path)).count() == 2        # the first records of b and c
