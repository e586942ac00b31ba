"""Ordered passes over groups of any size.

A window function puts a whole group into one task.  Here each group is cut into chunks along its
order, the window runs inside a chunk, and what has to be carried over (last row, sum, maximum) is
aggregated per chunk first, so only one small row per chunk meets in the second step.  The chunk
expression must not decrease along the order: a day or month of the time column, or a row number
divided by a fixed size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], *,
            last: list[str] = (), following: list[str] = (),
            sums: dict[str, Column] | None = None,
            maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds, per group and along the order:

    ``prev_<c>`` / ``next_<c>``  value of the row before / after, for each column in ``last`` /
    ``following``; ``name`` for each entry of ``sums`` and ``maxima``, up to and including the row.
    ``order`` must be unique within a group; add an id as its last column where times can be equal.
    """
    sums, maxima = sums or {}, maxima or {}
    rows = df.withColumn("_chunk", chunk)
    for name, expr in {**sums, **maxima}.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    key = [F.col(k) for k in keys]
    by = F.struct(*[F.col(c) for c in order])

    summary = []
    if last:
        summary.append(F.max_by(F.struct(*last), by).alias("_tail"))
    if following:
        summary.append(F.min_by(F.struct(*following), by).alias("_front"))
    summary += [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    summary += [F.max(f"_v_{n}").alias(f"_s_{n}") for n in maxima]
    chunks = rows.groupBy(*keys, "_chunk").agg(*summary)

    along = Window.partitionBy(*key).orderBy("_chunk") if keys else Window.partitionBy(
        F.lit(1)).orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [*key, F.col("_chunk")]
    if last:
        carried.append(F.lag("_tail").over(along).alias("_tail"))
    if following:
        carried.append(F.lead("_front").over(along).alias("_front"))
    carried += [F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums]
    carried += [F.max(f"_s_{n}").over(before).alias(f"_s_{n}") for n in maxima]
    carry = chunks.select(*carried)

    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows
    if last:
        local = (local.withColumn("_first", F.row_number().over(inside) == 1)
                 .withColumns({f"prev_{c}": F.lag(c).over(inside) for c in last}))
    if following:
        local = (local.withColumn("_end", F.lead(F.lit(1)).over(inside).isNull())
                 .withColumns({f"next_{c}": F.lead(c).over(inside) for c in following}))
    for n in sums:
        local = local.withColumn(n, F.sum(f"_v_{n}").over(upto))
    for n in maxima:
        local = local.withColumn(n, F.max(f"_v_{n}").over(upto))

    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_chunk"]]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = local.alias("l").join(carry.alias("c"), condition, "left")
    out = [F.col(f"l.{c}") for c in df.columns]
    for c in last:
        out.append(F.when(F.col("l._first"), F.col(f"c._tail.{c}"))
                   .otherwise(F.col(f"l.prev_{c}")).alias(f"prev_{c}"))
    for c in following:
        out.append(F.when(F.col("l._end"), F.col(f"c._front.{c}"))
                   .otherwise(F.col(f"l.next_{c}")).alias(f"next_{c}"))
    for n in sums:
        out.append((F.coalesce(F.col(f"l.{n}"), F.lit(0))
                    + F.coalesce(F.col(f"c._s_{n}"), F.lit(0))).alias(n))
    for n in maxima:
        out.append(F.greatest(F.col(f"l.{n}"), F.col(f"c._s_{n}")).alias(n))
    return joined.select(*out)
