"""WARC archives: writing, and reading in splits with boundary-chain verification.

Spark's text reader cuts the archives at every occurrence of the magic, in payloads too, wherever splits begin.
Tasks emit for each cut a candidate: its offset and that of the record that would follow it by its own length.
Only candidates that the chain from the start of the file reaches are records; they are found by pointer jumping,
in as many rounds as the logarithm of the records of a file.  What lies between two of them belongs to the first,
whatever magic it holds.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlake.session import cut_lineage, shared_folder

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_BYTES = 1000              # shorter payloads are never revisits
ARCHIVE_RECORDS = 4096          # records of an archive, at most

_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: *([0-9]{1,18}) *(?:\r\n|$)", re.I)
_FIELD = {n: re.compile(rb"(?:^|\r\n)" + h + rb": *([^\r\n]*)", re.I) for n, h in (
    ("type", b"WARC-Type"), ("record_id", b"WARC-Record-ID"), ("refers", b"WARC-Refers-To"),
    ("url", b"WARC-Target-URI"), ("said", b"WARC-Payload-Digest"))}


# ---- writing ----------------------------------------------------------------------------------------------------

def _urn(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", records: int = ARCHIVE_RECORDS) -> None:
    """Writes a record for each row of `pages` (page_id, url, html) to archives in the folder `path`.

    Of rows with equal payloads of LEAST_BYTES or more, those with the largest page_id are responses (a null id
    is below all), others are revisits of it without a payload of their own.  Null html is an empty payload; line
    ends in a url are escaped, a null url has no header; other columns play no part.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"), F.octet_length(html).alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    twice = cut_lineage(rows.where(F.col("n") >= LEAST_BYTES).groupBy("digest")
                        .agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    rows = rows.join(twice.withColumn("many", F.lit(True)), "digest", "left")
    revisit = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    headers = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    # the text writer ends each row, and so each record, with END
    (rows.select(F.concat(headers, block).alias("value")).write
     .option("lineSep", END).option("maxRecordsPerFile", records).text(path))


# ---- reading ----------------------------------------------------------------------------------------------------

def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies before, between and after magics, in the order of each split."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("split")))


_CANDIDATE = ("file string, split long, at long, bytes long, next long, whole boolean, type string, record_id string, "
              "refers string, url string, said string, payload_bytes long, payload_digest string")
_NAMES = [c.split()[0] for c in _CANDIDATE.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _CANDIDATE.split(", ")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """file, split, bytes of the split before a piece (its magic not counted), piece."""
    where, at = None, 0
    for batch in batches:
        for value, file, split in zip(*(batch.column(i) for i in range(3))):
            key = (file.as_py(), split.as_py())
            if key != where:
                where, at = key, 0
            piece = value.as_py()
            yield *key, at, piece
            at += len(piece) + len(MAGIC)


def parse(piece: bytes) -> tuple:
    """next (bytes from behind the magic to the next record's magic), whole, fields, payload bytes and digest."""
    head, found, rest = piece.partition(END.encode())
    length = _LENGTH.search(head) if found else None
    if not length:
        return (None, False, *[None] * 7)
    n = int(length[1])
    fields = [m[1].decode("utf-8", "replace") if (m := p.search(head)) else None for p in _FIELD.values()]
    after = len(head) + len(END) + n + len(END)
    if after != len(piece):
        return (after, False, *fields, None, None)
    payload = rest[:n].partition(END.encode())[2]
    return (after, True, *fields, len(payload), hashlib.sha1(payload).hexdigest())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def flush():
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)
    for file, split, at, piece in _walk(batches):
        rows.append((file, split, at, len(piece), *parse(piece)))
        if len(rows) >= 2000:
            yield flush()
            rows = []
    if rows:
        yield flush()


def _reached(nodes: DataFrame) -> DataFrame:
    """file, start of the nodes (file, start, next) that the chain from start 0 of their file reaches.

    In each round every node's pointer skips as many records as in all rounds before, and what reached nodes
    point at is reached.
    """
    state = cut_lineage(nodes.select("file", "start", F.col("next").alias("jump"), (F.col("start") == 0).alias("reached")))
    while state.where("reached AND jump IS NOT NULL").limit(1).count():
        hit = state.where("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("start"), F.lit(True).alias("hit")).distinct()
        beyond = state.select("file", F.col("start").alias("jump"), F.col("jump").alias("beyond"))
        state = cut_lineage(state.join(hit, ["file", "start"], "left").join(beyond, ["file", "jump"], "left").select(
            "file", "start", F.col("beyond").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
    return state.where("reached").select("file", "start")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to: a row for each record under `path`.

    A revisit has the bytes and digest of the response that it refers to.  A file that does not begin with the
    magic has no records; a chain ends where a record has no length or the next one does not follow.
    """
    cuts = cut_lineage(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE))
    # a split's place in its file: the pieces of the splits before, and their magics
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = (cuts.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("n"))
             .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    # offsets are those of the magic before a piece; the first piece of a file has none
    placed = cuts.join(bases, ["file", "split"]).withColumn("start", F.col("base") + F.col("at") - len(MAGIC))
    placed = cut_lineage(placed.withColumn("next", F.col("start") + len(MAGIC) + F.col("next")))
    nodes = placed.where("start >= 0 AND next IS NOT NULL")
    reached = cut_lineage(_reached(nodes))
    records = placed.join(reached, ["file", "start"])
    broken = cut_lineage(records.where(~F.col("whole")).select("file", "start", "next"))
    fields = ["file", "start", "type", "record_id", "refers", "url", "said", "payload_bytes", "payload_digest"]
    result = records.where("whole").select(*fields)
    if broken.limit(1).count():
        mended = _mend(spark, path, placed, broken, reached)
        result = result.unionByName(records.where(~F.col("whole")).drop("payload_bytes", "payload_digest")
                                    .join(mended, ["file", "start"]).select(*fields))
    result = cut_lineage(result.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') AS BIGINT)").alias("page_id"), "url",
        F.col("type").alias("record_type"), "refers", "record_id", "said", "payload_bytes", "payload_digest"))
    responses = (result.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers"), "said")
                 .agg(F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"), F.max("page_id").alias("refers_to")))
    revisits = (result.where("record_type = 'revisit'").join(responses, ["refers", "said"], "left")
                .select("page_id", "url", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"))
    return (result.where("record_type <> 'revisit'")
            .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits))


def _mend(spark: SparkSession, path: str, placed: DataFrame, broken: DataFrame, reached: DataFrame) -> DataFrame:
    """file, start, payload_bytes, payload_digest of the records whose payloads hold the magic.

    The pieces of such a record are read again and put together; no more than one record is held at once.
    """
    files = broken.select("file").distinct()
    last = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = (placed.join(files, "file", "left_semi").where("start >= 0")
             .join(reached.withColumn("own", F.col("start")), ["file", "start"], "left")
             .withColumn("owner", F.last("own", ignorenulls=True).over(last))
             .select("file", "split", "at", "start", "owner"))
    wanted = cut_lineage(owned.join(broken.select("file", F.col("start").alias("owner"), F.col("next").alias("end")), ["file", "owner"])
                         .where("start < end"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, at, piece in _walk(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split]), pa.array([at]), pa.array([piece], pa.binary())],
                                             names=["file", "split", "at", "piece"])

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("start").to_pylist(), table.column("piece").to_pylist()))
        size = table.column("end")[0].as_py() - table.column("owner")[0].as_py() - len(MAGIC)
        *_, n, digest = parse(MAGIC.encode().join(p for _, p in parts)[:size])
        return pa.table({"file": table.column("file").slice(0, 1), "start": table.column("owner").slice(0, 1),
                         "payload_bytes": pa.array([n], pa.int64()), "payload_digest": pa.array([digest], pa.string())})

    pieces = _pieces(spark, path).mapInArrow(again, "file string, split long, at long, piece binary")
    return (pieces.join(wanted, ["file", "split", "at"]).groupBy("file", "owner")
            .applyInArrow(join, "file string, start long, payload_bytes long, payload_digest string"))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of `pages`, written and read back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
