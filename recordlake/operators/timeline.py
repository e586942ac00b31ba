"""Ordered analyses: eras, gaps, versions, later mentions, sliding counts, running spend."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.operators.running import running
from recordlake.session import cut_lineage


def eras(events: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column
         ) -> DataFrame:
    """WN1: runs of equal values along the order, missing values skipped."""
    known = events.where(F.col(value).isNotNull())
    linked = running(known, keys, chunk, order, last=[value])
    opens = (F.col(f"prev_{value}").isNull() | (F.col(f"prev_{value}") != F.col(value))).cast("bigint")
    numbered = running(linked, keys, chunk, order, sums={"era": opens})
    at = F.struct(*order)
    return numbered.groupBy(*keys, "era", value).agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def gaps(events: DataFrame, keys: list[str], date: str, days: int) -> DataFrame:
    """WN2: neighbouring dates more than so many days apart.

    Dates are made distinct first, so a group is bounded by the calendar however many rows it has.
    """
    distinct = events.select(*keys, F.to_date(date).alias("after")).distinct()
    following = F.lead("after").over(Window.partitionBy(*keys).orderBy("after"))
    return (distinct.withColumn("before", following)
            .withColumn("days", F.datediff("before", "after")).where(F.col("days") > days))


def missing_ranges(events: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """WN3: runs of missing numbers (years, days) between the first and the last one present."""
    present = events.select(*keys, number.alias("n")).distinct()
    following = F.lead("n").over(Window.partitionBy(*keys).orderBy("n"))
    return present.withColumn("f", following).where(F.col("f") - F.col("n") > 1).select(
        *keys, (F.col("n") + 1).alias("first"), (F.col("f") - 1).alias("last"))


def range_label(first: str, last: str) -> Column:
    return F.when(F.col(first) == F.col(last), F.col(first).cast("string")).otherwise(
        F.concat(F.col(first).cast("string"), F.lit("–"), F.col(last).cast("string")))


def unique_names(rows: DataFrame, date: str, ident: str) -> DataFrame:
    """WN4: the first row of a date is named by the date, later ones by date and id."""
    day = F.date_format(date, "yyyy-MM-dd")
    first = rows.groupBy(F.to_date(date).alias("_day")).agg(F.min(ident).alias("_first"))
    return (rows.join(first, F.to_date(date) == F.col("_day"))
            .withColumn("name", F.when(F.col(ident) == F.col("_first"), day)
                        .otherwise(F.concat(day, F.lit("-"), F.col(ident).cast("string"))))
            .drop("_day", "_first"))


def version_chain(fetches: DataFrame, keys: list[str], order: list[str], content: str,
                  chunk: Column) -> DataFrame:
    """WN5: a new version where the content differs from the fetch before (SCD 2)."""
    compared = running(fetches, keys, chunk, order, last=[content])
    changed = compared.where(~F.col(f"prev_{content}").eqNullSafe(F.col(content))).drop(
        f"prev_{content}")
    head = order[0]
    return (running(changed, keys, chunk, order, sums={"version": F.lit(1).cast("bigint")},
                    following=[head])
            .withColumnRenamed(f"next_{head}", "superseded_at")
            .withColumn("is_current", F.col("superseded_at").isNull()))


def later_mentions(rows: DataFrame, keys: list[str], date: str, pending: Column) -> DataFrame:
    """WN6: for rows with a follow-up: later dates of their thread, and meetings held since."""
    from recordlake.operators.analytics import later_dates_within
    from recordlake.operators.linking import later_counts
    within = later_dates_within(rows, keys, date)
    held = later_counts(rows.select(F.to_date(date).alias("held")).distinct(), "held")
    return (rows.where(pending).withColumn("day", F.to_date(date))
            .join(within, [*keys, "day"]).join(held, F.col("day") == F.col("held")).drop("held"))


def previous_text(rows: DataFrame, keys: list[str], order: str, text: str, chunk: int = 1000
                  ) -> DataFrame:
    """WN7: the text before each row, '' for the first."""
    out = running(rows, keys, F.floor(F.col(order) / chunk), [order], last=[text])
    return out.withColumn(f"prev_{text}", F.coalesce(f"prev_{text}", F.lit("")))


def carried_flag(rows: DataFrame, keys: list[str], order: list[str], own: Column, passes: Column,
                 chunk: Column, name: str = "flag") -> DataFrame:
    """WN8: flag(i) = own(i) or (flag(i-1) and passes(i)), as two running positions."""
    at = F.struct(*order)
    out = running(rows, keys, chunk, order, maxima={
        "_own_at": F.when(own, at), "_stop_at": F.when(~passes, at)})
    return out.withColumn(name, F.col("_own_at").isNotNull() & (
        F.col("_stop_at").isNull() | (F.col("_own_at") >= F.col("_stop_at")))).drop(
        "_own_at", "_stop_at")


def dedupe_keep_first(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """WN9: the first row per key.  Only keys and order values are aggregated; rows are filtered."""
    first = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(order).alias("_first"))
    return rows.join(first.select(F.col("_first").alias(order)), order, "left_semi")


def sample_per_category(rows: DataFrame, category: str, ident: str, k: int, seed: str) -> DataFrame:
    """WN10: k rows per category, the same ones for the same seed."""
    from recordlake.operators.analytics import top_k
    draw = F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(ident).cast("string")), 256)
    return top_k(rows.withColumn("_draw", draw), [category], [F.col("_draw"), F.col(ident)], k).drop(
        "_draw", "rank")


def pack_batches(segments: Column, limit: int = lx.BATCH_CHARS, most: int = lx.BATCH_ITEMS) -> Column:
    """WN11: batch number (from 1) of each segment of a document, packed greedily in order.

    A document is one row, so the greedy walk is a fold over its array of segments.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("size"),
                     F.array().cast("array<int>").alias("out"))

    def step(acc, s):
        full = (acc["n"] == 0) | (acc["size"] + F.length(s) > limit) | (acc["n"] >= most)
        batch = acc["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
                        F.when(full, F.length(s)).otherwise(acc["size"] + F.length(s)).alias("size"),
                        F.array_append(acc["out"], batch).alias("out"))
    return F.aggregate(segments, start, step, lambda acc: acc["out"])


def ordinals(rows: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """WN12: running number within the key."""
    return running(rows, keys, chunk, order, sums={"ordinal": F.lit(1).cast("bigint")})


def page_span(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """WN12: first and last page."""
    return rows.groupBy(*keys).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def sliding_count(hits: DataFrame, keys: list[str], time: str, seconds: int, limit: int) -> DataFrame:
    """WN13: hits of the same client in the last seconds, this one included, and whether over limit.

    Each hit is copied into the next time slot as history, so a window holds two slots of one client
    and never the client's whole log.
    """
    epoch = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{time}`)")
    width = seconds * 1_000_000
    placed = hits.withColumn("_t", epoch).withColumn(
        "_slot", F.floor(F.col("_t") / width)).withColumn(
        "_in", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_slot", F.col("_slot") + F.col("_in"))
    span = Window.partitionBy(*keys, "_slot").orderBy("_t").rangeBetween(-(width - 1), 0)
    return (placed.withColumn("hits", F.count("*").over(span)).where(F.col("_in") == 0)
            .withColumn("over_limit", F.col("hits") > limit).drop("_t", "_slot", "_in"))


def running_spend(rows: DataFrame, order: list[str], cost: Column, cap: float, chunk: Column | None = None
                  ) -> DataFrame:
    """WN14: cumulative cost over the whole table and whether the cap is passed.

    Without a ``chunk`` the rows are dealt out by ranges of their order, of about equal size, and written; sums of the ranges
    before come on top of those inside.  So no task gets more than its range, however many rows a day has.
    """
    if chunk is None:
        ranged = rows.withColumn("_cost", cost).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
        rows, chunk, cost = cut_lineage(ranged), F.col("_range"), F.col("_cost")
    out = running(rows, [], chunk, order, sums={"spent": cost.cast("decimal(18,2)")}).drop("_range", "_cost")
    return out.withColumn("over_cap", F.col("spent") > F.lit(cap)).withColumn(
        "spent", F.col("spent").cast("double"))
