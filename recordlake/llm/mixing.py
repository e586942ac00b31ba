"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is met by complete epochs of all its documents and one fractional selection.  For that, each
document draws an exponential key, divided by its quality weight; documents are taken in the order of their keys
until their words fill what is left of the target.  The place where a source's order is cut is found with sums
over buckets of the key, so no source is sorted in one task; whether a document is taken then follows from its
own key and its source's cut.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.operators.running import running
from recordlake.session import cut_lineage

WEIGHTS = (5, 2, 1)             # of the sources in the order of their names, repeating
MOST_EPOCHS = 3
BUCKET_ROWS = 2000              # rows that a bucket of keys holds, about
CHUNK_BUCKETS = 4096            # buckets of a source that one task adds up

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """1 for texts without symbols, less the more symbols a word has."""
    return 1 / (1 + F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)) / F.greatest(size, F.lit(1)))


def draw(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """An exponential key of rate `weight` from a hash of the id."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"/{seed}"))
    uniform = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return -F.ln(uniform) / weight


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weight: Column | None = None, seed: int = 0) -> DataFrame:
    """`docs` and __id, __source, __size, __key, __tie.  weight: above zero; by default the text's quality.

    Ties of the key are broken by the id, then by the text's checksum; rows that agree in all are alike, and where the
    cut falls among them as many are taken as fit.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    sized = docs.select("*", doc_id.alias("__id"), F.col(f"`{source_col}`").alias("__source"),
                        size_of(text).alias("__size"),
                        F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("__tie"))
    weight = quality_of(text, F.col("__size")) if weight is None else weight
    return sized.withColumn("__key", draw(F.col("__id"), weight, seed))


KEYS = ("__id", "__source", "__size", "__key", "__tie")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """__source, source_size, target.  `sizes` has __source and source_size, a row for each source.

    The sum of targets is `share` of all sizes, dealt by weight; none is above MOST_EPOCHS times its source.
    The level at which sources fill up is found by passing over them in the order in which they fill up.
    """
    named = Window.orderBy(F.col("__source").asc_nulls_last())
    n = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), n)).withColumn(
        "cap", F.col("source_size") * MOST_EPOCHS)
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("__source").asc_nulls_first())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # the level if all sources before this one are full and no later one is; it rises until one stays open
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / F.sum("w").over(after))
    open_level = F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(whole)
    return levels.select("__source", "source_size", F.coalesce(
        F.least(F.col("cap").cast("double"), open_level * F.col("w")), F.col("cap").cast("double")).alias("target"))


def plan(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """__from, __source_size, __target, __epochs, __bucket_cut, __cut, __buckets for each source of the KEYS in `keyed`.

    `keyed` is read several times, so it should be a written table.
    """
    buckets = keyed.count() // BUCKET_ROWS + 1
    place = F.floor((1 - F.exp(-F.col("__key"))) * buckets)
    rows = keyed.select(*KEYS).withColumn("__bucket", place)
    sums = cut_lineage(rows.groupBy("__source", "__bucket").agg(F.sum("__size").alias("s")))
    sources = targets(sums.groupBy("__source").agg(F.sum("s").alias("source_size")), weights, share)
    empty = F.col("source_size") == 0
    sources = cut_lineage(sources.select(
        F.col("__source").alias("__from"), "source_size", "target",
        F.when(empty, 1).otherwise(F.floor(F.col("target") / F.when(~empty, F.col("source_size")))).cast("long").alias("__epochs"))
        .withColumn("__budget", F.greatest(F.lit(0.0), F.col("target") - F.col("__epochs") * F.col("source_size"))))
    # a source's buckets are added up in chunks, rows that are alike as one
    upto = running(sums, ["__source"], F.floor(F.col("__bucket") / CHUNK_BUCKETS), ["__bucket"], sums={"upto": F.col("s")})
    cut = (upto.withColumn("before", F.col("upto") - F.col("s"))
           .join(sources, F.col("__source").eqNullSafe(F.col("__from")))
           .where(F.col("before") <= F.col("__budget"))
           .groupBy(F.col("__source").alias("__s"), "__budget")
           .agg(F.max("__bucket").alias("__b"), F.max("before").alias("before")))
    inside = Window.partitionBy("__source").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("__size")
    room = F.col("__budget") - F.col("before") - F.col("ahead")
    fit = F.when(size > 0, F.floor(room / F.when(size > 0, size) + 0.5)).when(room >= 0, F.col("__alike")).otherwise(F.lit(0))
    last = (rows.join(cut, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
            .groupBy(*KEYS, "__b", "before", "__budget").agg(F.count("*").alias("__alike"))
            .withColumn("ahead", F.coalesce(F.sum(F.col("__alike") * size).over(inside), F.lit(0)))
            .withColumn("__fit", F.least(F.col("__alike"), fit.cast("long")))
            .groupBy(F.col("__source").alias("__s"), F.col("__b"))
            .agg(F.max(F.when(F.col("__fit") > 0, F.struct(
                F.struct("__key", F.struct("__id").alias("__id"), "__tie").alias("at"), "__fit", "__alike"))).alias("__cut")))
    return cut_lineage(sources.join(last, F.col("__from").eqNullSafe(F.col("__s")), "left").select(
        "__from", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__epochs",
        F.col("__b").alias("__bucket_cut"), "__cut", F.lit(buckets).alias("__buckets")))


def apply(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """`keyed` and __source_size, __target, __times: how often each row is taken."""
    joined = keyed.join(cuts, F.col("__source").eqNullSafe(F.col("__from")))
    bucket = F.floor((1 - F.exp(-F.col("__key"))) * F.col("__buckets"))
    order = F.struct("__key", F.struct("__id").alias("__id"), "__tie")
    here = bucket == F.col("__bucket_cut")
    more = (bucket < F.col("__bucket_cut")) | (here & F.coalesce(order <= F.col("__cut.at"), F.lit(False)))
    times = F.col("__epochs") + F.coalesce(more, F.lit(False)).cast("long")
    if cuts.where("__cut.__fit < __cut.__alike").isEmpty():
        return joined.withColumn("__times", times)
    split = F.coalesce(here & (order == F.col("__cut.at")) & (F.col("__cut.__fit") < F.col("__cut.__alike")), F.lit(False))
    # some of the rows that are alike: they are numbered by the task that wrote them, then within it
    alike = cut_lineage(joined.where(split).withColumn("__task", F.spark_partition_id()))
    tasks = alike.groupBy("__source", "__task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__source").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col("__source").alias("__s"), F.col("__task").alias("__t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    number = F.row_number().over(Window.partitionBy("__source", "__task").orderBy("__size")) + F.col("__ahead")
    numbered = (alike.join(tasks, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
                .withColumn("__times", F.col("__epochs") + (number <= F.col("__cut.__fit")).cast("long")))
    return joined.where(~split).withColumn("__times", times).unionByName(numbered.drop("__task", "__s", "__t", "__ahead"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document.

    Null and empty texts have size 0 and are taken with no words; a null source is a source, the last by name;
    repeated rows draw the same key, and the cut may fall among them; an empty table gives an empty result; other columns play no part.
    """
    keyed = cut_lineage(with_keys(docs.select("doc_id", "text", "source")).select(*KEYS))
    return apply(keyed, plan(keyed)).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__times") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as the mix takes it (at most three times).

    Texts are not shuffled: a row's key is compared with its source's cut.  Rows without words are taken by
    their keys like any other; columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "source")
    keyed = cut_lineage(with_keys(docs).select(*KEYS))
    taken = apply(with_keys(rows), plan(keyed)).where("__times > 0")
    return (taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
            .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
