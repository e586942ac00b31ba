"""Line deduplication by a deletion-neighbourhood join.

A line goes if the same words, or words within one edit (a word put in, left out or replaced), stand in an
earlier line; earlier means a smaller (doc_id, line number).  Lines with one edit between them have a variant in
common: the line without one word, or the line itself.  Variants are hashed and joined.  Among lines that give
the same variant by leaving out the word at the same place any two are within one edit, so the earliest of them
is all that the others need, and groups of any size are only aggregated.

Only lines that share their first or last half with another line emit variants: a single edit leaves one of the
halves as it was.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm.texts import INVERSE, mark, numbers, packed, prefix_sums, unpacked
from recordlake.session import cut_lineage

LEAST_WORDS = 10                # lines with fewer words go only for a line with the same words

_SIGNED = 2 ** 63


def _signed(x: int) -> int:
    return x - 2 * _SIGNED if x >= _SIGNED else x


def half_keys(words: list[bytes]) -> tuple[list[int], list[int]]:
    """Hashes of beginnings and of ends, such that lines within one edit of each other share one of either kind.

    If the shorter of the two lines has n words, the beginnings or the ends of 2 * (n // 4) words are equal.
    """
    n = len(words)
    front, back = [], []
    for m in {2 * (n // 4), 2 * ((n - 1) // 4), 2 * ((n + 1) // 4)}:
        front.append(_signed(xxhash.xxh64_intdigest(b" ".join(words[:m]), m)))
        back.append(_signed(xxhash.xxh64_intdigest(b" ".join(words[n - m:]), m + _SIGNED)))
    return front, back


_LINES = "mark long, line int, h1 long, h2 long, front array<long>, back array<long>"
_LINE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(c.split()[0] for c in _LINES.split(", "))]
    rows: list[tuple] = []
    kind = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, *_LINE_TYPES])], names=names)
    for batch in batches:
        kind = batch.column(0).type
        for doc_id, m, text in zip(*(batch.column(i) for i in range(3))):
            doc_id, m, text = doc_id.as_py(), m.as_py(), text.as_py()
            for place, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                words = line.split()
                if words:
                    h = xxhash.xxh3_128_intdigest(b" ".join(words))
                    front, back = half_keys(words) if len(words) >= LEAST_WORDS else (None, None)
                    rows.append((doc_id, m, place, _signed(h >> 64), _signed(h & (2 * _SIGNED - 1)), front, back))
            if len(rows) >= 5000:
                yield flush()
                rows = []
    if rows:
        yield flush()


def _id(docs: DataFrame) -> str:
    """The id column as DDL; ids may be of any type that has an order."""
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def classes(docs: DataFrame) -> DataFrame:
    """h1, h2, first (the earliest place), front, back: a row for each line that has words, equal lines as one."""
    lines = docs.select("doc_id", mark().alias("mark"), "text").mapInArrow(_lines, f"{_id(docs)}, {_LINES}")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line")
    return lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("front").alias("front"), F.first("back").alias("back"))


def _sharing_half(found: DataFrame) -> DataFrame:
    """h1, front, back: lines (by half of their hash) whose beginning or end another line has too."""
    keys = found.where(F.col("front").isNotNull()).select(
        "h1", F.explode(F.concat(F.transform("front", lambda k: F.struct(k.alias("k"), F.lit(True).alias("front"))),
                                 F.transform("back", lambda k: F.struct(k.alias("k"), F.lit(False).alias("front"))))).alias("key"))
    keys = keys.select("h1", "key.k", "key.front")
    common = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return (keys.join(common, "k", "left_semi").groupBy("h1")
            .agg(F.max("front").alias("by_front"), F.min("front").alias("f")).select("h1", "by_front", (~F.col("f")).alias("by_back")))


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted lines."""
    for batch in batches:
        rows = []
        for doc_id, m, raw, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines = unpacked(raw).split(b"\n")
            for w in wanted:
                rows.append((doc_id, m, w["line"], w["h1"], w["h2"], w["by_front"], w["by_back"], b" ".join(lines[w["line"]].split())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))],
            names=["doc_id", "mark", "line", "h1", "h2", "by_front", "by_back", "words"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the line itself (place -1), and of the line without each word of the half that may differ."""
    for batch in batches:
        for rank, by_front, by_back, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = raw.split()
            n = len(words)
            sums = prefix_sums(numbers(words))
            half = 2 * ((n - 1) // 4)
            at = np.arange(0 if by_back else half, n if by_front else n - half)
            without = sums[at] + (sums[n] - sums[at + 1]) * INVERSE
            hashes = np.append(without, sums[n]).view(np.int64)
            place = np.append(at, -1).astype(np.int32)
            size = np.append(np.full(len(at), n - 1), n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(size), pa.array(place), pa.array(np.full(len(place), rank, np.int64))],
                                             names=["variant", "size", "place", "rank"])


def within_one_edit(a: list, b: list) -> bool:
    """Whether a word put in, left out or replaced makes `a` into `b`."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if len(a) == len(b):
        return a[same + 1:] == b[same + 1:]
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[same:] == long[same + 1:]


def _edited(lines: DataFrame) -> DataFrame:
    """rank of the lines (rank, by_front, by_back, words) with a line of a smaller rank within one edit."""
    variants = lines.select("rank", "by_front", "by_back", "words").mapInArrow(_variants, "variant long, size int, place int, rank long")
    key = ["variant", "size", "place"]
    least = variants.groupBy(*key).agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    both = Window.partitionBy("variant", "size")                # at most a row for each place of a line
    whole = F.min(F.when(F.col("place") < 0, F.col("low"))).over(both)
    others = F.min(F.when(F.col("place") >= 0, F.col("low"))).over(both)
    limits = (least.withColumn("earliest", F.when(F.col("place") < 0, others).otherwise(F.least("low", whole)))
              .where(F.col("high") > F.col("earliest")).select(*key, "earliest"))
    pairs = variants.join(limits, key).where(F.col("rank") > F.col("earliest")).select("rank", "earliest").distinct()
    words = lines.select("rank", "words")
    both_words = (pairs.join(words, "rank")
                  .join(words.select(F.col("rank").alias("earliest"), F.col("words").alias("earlier")), "earliest"))
    check = F.pandas_udf(lambda a, b: pd.Series([within_one_edit(x.split(), y.split()) for x, y in zip(a, b)], dtype=bool), "boolean")
    return both_words.where(check("words", "earlier")).select("rank").distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, lines: the numbers of the lines with words that stay, for documents that have some."""
    found = cut_lineage(classes(docs))
    wanted = (found.join(_sharing_half(found), "h1")
              .groupBy("first.doc_id", "first.mark")
              .agg(F.collect_list(F.struct("first.line", "h1", "h2", "by_front", "by_back")).alias("wanted")))
    texts = docs.select("doc_id", mark().alias("mark"), packed(F.col("text")).alias("raw"))
    same = _same_document("doc_id", "mark", "w_doc", "w_mark")
    near = (texts.join(wanted.select(F.col("doc_id").alias("w_doc"), F.col("mark").alias("w_mark"), "wanted"), same)
            .select("doc_id", "mark", "raw", "wanted").dropDuplicates(["doc_id", "mark"])
            .mapInArrow(_line_texts, f"{_id(docs)}, mark long, line int, h1 long, h2 long, by_front boolean, by_back boolean, words binary"))
    # ranks follow the order of places
    ranked = cut_lineage(near.orderBy(F.col("doc_id").asc_nulls_last(), "mark", "line").withColumn("rank", F.monotonically_increasing_id()))
    gone = ranked.join(_edited(ranked), "rank").select("h1", "h2")
    return (found.join(gone, ["h1", "h2"], "left_anti").groupBy("first.doc_id", "first.mark")
            .agg(F.collect_list("first.line").alias("lines")))


def _same_document(a_id: str, a_mark: str, b_id: str, b_mark: str):
    return F.col(a_id).eqNullSafe(F.col(b_id)) & (F.col(a_mark) == F.col(b_mark))


def _assembled(raw: pd.Series, kept: pd.Series) -> pd.DataFrame:
    texts, before, after = [], [], []
    for z, numbers_kept in zip(raw, kept):
        lines = unpacked(z).split(b"\n")
        stay = set() if numbers_kept is None else set(map(int, numbers_kept))
        left = [x for i, x in enumerate(lines) if i in stay or not x.split()]
        texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
        before.append(len(lines))
        after.append(len(left))
    return pd.DataFrame({"text": texts, "lines": before, "kept": after})


def clean(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, and in `text` only the lines that stay; n_lines, n_kept.

    Words are what stands between ASCII blanks, as they are written.  Lines without words stay.  A null text
    stays null (0 lines); a text may become empty.  Ids may have any type with an order, which is that of the documents.  A null doc_id comes after all others; texts of the same id are
    ordered by a checksum, and rows with the same id and text are one document: their lines stay in each of them.
    Columns n_lines and n_kept of `docs` are replaced.
    """
    kept = kept_lines(docs.select("doc_id", "text"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_kept")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("doc_id").alias("a_id"),
                       mark().alias("a_mark"), F.col("text").isNull().alias("none"), packed(F.col("text")).alias("raw"))
    kept = kept.select(F.col("doc_id").alias("b_id"), F.col("mark").alias("b_mark"), "lines")
    put = F.pandas_udf(_assembled, "text string, lines int, kept int")
    joined = (rows.join(kept, _same_document("a_id", "a_mark", "b_id", "b_mark"), "left")
              .select("row", "none", put("raw", "lines").alias("new")))
    columns = {c: F.col(f"row.`{c}`").alias(c) for c in others}
    columns["text"] = F.when(~F.col("none"), F.col("new.text")).alias("text")
    ends = [F.when(F.col("none"), 0).otherwise(F.col(f"new.{c}")).cast("long").alias(n) for c, n in (("lines", "n_lines"), ("kept", "n_kept"))]
    return joined.select(*[columns[c] for c in docs.columns if c in columns], *ends)
