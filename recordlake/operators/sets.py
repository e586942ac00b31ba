"""Small operators over whole tables: newest rows, orderings, unions, differences, distinct counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, date: str, n: int, *ties: str) -> DataFrame:
    """TK1: the n newest rows; equal dates are ordered by ``ties``."""
    return rows.orderBy(F.desc(date), *ties).limit(n)


def ordered_by_size(groups: DataFrame, size: str, first: str, *ties: str) -> DataFrame:
    """TK3: largest groups first, then the earliest, undated ones last."""
    return groups.orderBy(F.desc(size), F.asc_nulls_last(first), *ties)


def union_sources(tables: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """SO1: rows of all tables with the name of theirs; columns that a table lacks are null."""
    if not tables:
        raise ValueError("no tables")
    out = None
    for name, df in tables.items():
        named = df.withColumn(label, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def except_known(site: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """SO3: distinct keys of ``site`` that ``known`` has not; a null key is known if ``known`` has one."""
    theirs = known.select(F.col(key).alias("_known")).distinct()
    return site.select(key).distinct().join(theirs, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def distinct_keep_order(values: Column) -> Column:
    """SO4: first occurrences, in order."""
    return F.array_distinct(values)


def distinct_counts(rows: DataFrame, by: str, candidate: str, held_back: Column, meeting: str) -> DataFrame:
    """AG27: items, distinct candidates and meetings, and items held back, for each value of ``by``."""
    return rows.groupBy(by).agg(
        F.count("*").alias("items"), F.count_distinct(candidate).alias("candidates"),
        F.count_if(held_back).alias("held_back"), F.count_distinct(meeting).alias("meetings"))
