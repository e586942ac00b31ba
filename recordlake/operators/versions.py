"""Versions of documents: page differences, line differences, hashes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions import text as t


def diff_pages(old: DataFrame, new: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """JN8: status of every page: added, removed, unchanged, whitespace_only or changed."""
    o = old.select(*keys, F.col(text).alias("old_text"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col(text).alias("new_text"), F.lit(True).alias("_n"))
    status = (F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
              .when(F.col("old_text") == F.col("new_text"), "unchanged")
              .when(t.squeeze("old_text") == t.squeeze("new_text"), "whitespace_only")
              .otherwise("changed"))
    return o.join(n, keys, "full_outer").withColumn("status", status).drop("_o", "_n")


STATUSES = ["unchanged", "whitespace_only", "changed", "added", "removed"]


def diff_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """DF3: pages per status, pages before and after, whether the text changed."""
    s = F.col("status")
    return pages.groupBy(*by).agg(
        *[F.count_if(s == x).alias(x) for x in STATUSES],
        F.count_if(s != "added").alias("pages_before"),
        F.count_if(s != "removed").alias("pages_after"),
        F.bool_or(s.isin("changed", "added", "removed")).alias("text_changed"))


def similarity(a, b) -> Column:
    """DF1, native form: 1 - edit distance / longer length.  ``sequences.matching_ratio`` is exact."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def line_changes(old: DataFrame, new: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """DF2: lines added and removed with their number, as multisets.

    Old lines count down and new lines up in one aggregation, so equal lines cancel before the
    shuffle where they meet in a task.
    """
    signed = (new.select(*keys, line, F.lit(1).alias("d"))
              .unionByName(old.select(*keys, line, F.lit(-1).alias("d"))))
    net = signed.groupBy(*keys, line).agg(F.sum("d").alias("net")).where("net <> 0")
    return net.select(*keys, line, F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"),
                      F.abs("net").alias("n"))


def verify_hashes(records: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """JN14: does the stored hash match the bytes at hand; NULL when there are none."""
    return records.join(actual.select(key, F.col("sha256").alias("found")), key, "left").withColumn(
        "matches", F.col("found") == F.col("expected"))


def file_hashes(spark, path: str) -> DataFrame:
    """Hashes of files under a path: (path, sha256, size)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
