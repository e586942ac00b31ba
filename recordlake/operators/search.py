"""Full-text search: postings table, BM25, highlighting and lookups."""
from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.session import cut_lineage


def search_rows(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """SO2: items and summaries in one table of kind, ref, lang, title, body."""
    items = documents.select(
        F.lit("item").alias("kind"), F.col("doc_id").cast("string").alias("ref"), "lang",
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    summaries = conversations.select(
        F.lit("summary").alias("kind"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"),
        F.lit("fr").alias("lang"), F.lit("").alias("title"), F.col("text").alias("body"))
    return items.unionByName(summaries)


def search_tokens(c) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(t.fold(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def build_index(rows: DataFrame) -> DataFrame:
    """FT2: postings (term, kind, ref, lang, tf, doc_len).

    Length is known inside the row; counting is partial in the task that holds the row.
    """
    tokens = search_tokens(F.concat_ws(" ", "title", "body"))
    return (rows.select("kind", "ref", "lang", tokens.alias("tokens"))
            .withColumn("doc_len", F.size("tokens"))
            .select("kind", "ref", "lang", "doc_len", F.explode("tokens").alias("term"))
            .groupBy("term", "kind", "ref", "lang", "doc_len").agg(F.count("*").alias("tf")))


def _row_counts(tokens: Column) -> Column:
    """Array of struct(term, tf): how often each token stands in an array; null where there is none."""
    def counted(ts):
        new = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
        return F.when(F.size(ts) > 0, t.let(new, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ts, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ts)) - i).alias("tf")))))
    return t.let(F.sort_array(tokens), counted)


def corpus_size(rows: DataFrame) -> DataFrame:
    """Number of rows and mean length, one row."""
    n = F.size(search_tokens(F.concat_ws(" ", "title", "body")))
    return rows.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_len"))


def parse_query(q: str) -> list[tuple[str, bool]]:
    """FT1: words of a query, the last one a prefix; everything else is inert."""
    found = re.findall(r"\w+", q or "")
    return [(w, i == len(found) - 1) for i, w in enumerate(found)]


def clamp_limit(n, most: int | None = None) -> int:
    """TK4: at least one result; at most `most` where a deployment sets that."""
    return max(1, int(n) if most is None else min(int(n), most))


def search(postings: DataFrame, size: DataFrame, q: str, limit: int = 10, lang: str | None = None
           ) -> DataFrame:
    """FT3: rows that hold every word (the last as prefix), best BM25 first.

    Only postings of the asked terms are read (a filter on the first column of the index).  Ties are
    ordered by kind and reference.
    """
    words = parse_query(q)
    if not words:
        return postings.select("kind", "ref", "lang", F.lit(0.0).alias("score")).limit(0)
    folded = [(spark_fold(w), prefix) for w, prefix in words]
    tests = [F.col("term").startswith(w) if prefix else F.col("term") == w for w, prefix in folded]
    any_of = tests[0]
    for test in tests[1:]:
        any_of = any_of | test
    # A term can answer several words of the query; give each word its own column of hits.
    n = len(tests)
    per_row = postings.where(any_of).groupBy("kind", "ref", "lang", "doc_len").agg(
        *[F.sum(F.when(test, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, test in enumerate(tests)])
    seen = per_row.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)])
    # Two single rows beside the rows that were hit: the corpus and how often each word was met.
    facts = seen.withColumn("one", F.lit(1)).join(size.withColumn("one", F.lit(1)), "one")
    score, every = F.lit(0.0), F.lit(True)
    for i in range(n):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.ln((F.col("n_docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        norm = lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * F.col("doc_len") / F.coalesce(F.nullif("avg_len", F.lit(0)), F.lit(1.0)))
        score = score + idf * tf * (lx.BM25_K1 + 1) / (tf + norm)
        every = every & (tf > 0)
    if lang:
        every = every & (F.col("lang") == lang)
    return (per_row.withColumn("one", F.lit(1)).join(F.broadcast(facts), "one").where(every)
            .select("kind", "ref", "lang", F.round(score, 6).alias("score"))
            .orderBy(F.desc("score"), "kind", "ref").limit(clamp_limit(limit)))


BLOCK_DOCS = 65_536         # rows of a block of the stored index, about
LEVELS = 2                  # levels of length between a number and its double


def _segment_path(spark: SparkSession, path: str, segment: int):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/size/segment={segment}")
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def _dealt_postings(rows: DataFrame, level: Column, part: Column) -> DataFrame:
    """Postings as `build_index` gives them, with level and part, each lot of a term, level and part in one task.

    Words are counted inside the row, so postings are shuffled once, to where they are written; rows of one name meet there.
    """
    tokens = t.settled(search_tokens(F.concat_ws(" ", "title", "body")))
    hits = (rows.select("kind", "ref", "lang", tokens.alias("tokens"))
            .select("kind", "ref", "lang", F.size("tokens").alias("doc_len"), t.settled(_row_counts(F.col("tokens"))).alias("hits"))
            .select("kind", "ref", "lang", "doc_len", F.inline("hits")))
    return (hits.withColumn("level", level).withColumn("part", part).repartition("term", "level", "part")
            .groupBy("term", "kind", "ref", "lang", "doc_len", "level", "part").agg(F.sum("tf").alias("tf"))
            .select("term", "kind", "ref", "lang", "doc_len", "tf", "level", "part"))


def store_index(rows: DataFrame, path: str) -> int:
    """FT2: adds a segment to a stored index and returns its number; what is there is left as it is.

    Rows fall into blocks by their length (long levels into parts), the same for all terms; postings are dealt out by term and
    block, so a frequent term is in many files, and lie in that order.  Beside them stand, for each term and block, how many rows it has, the most hits in one and the least length:
    enough for a bound of any score in the block.  The size is written last, so a segment that broke off is overwritten.
    """
    spark, segment = rows.sparkSession, 0
    while _segment_path(spark, path, segment):
        segment += 1
    level = F.floor(F.log2(F.greatest("doc_len", F.lit(1))) * LEVELS).cast("int")
    lengths = rows.select(F.size(search_tokens(F.concat_ws(" ", "title", "body"))).alias("doc_len"))
    # a text has fewer than 2 ** 31 words, so there are 64 levels at most
    levels = lengths.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("doc_len").alias("len")).collect()
    parts = F.create_map(*[F.lit(x) for r in levels for x in (r["level"], -(-r["n"] // BLOCK_DOCS))]) if levels else F.create_map(F.lit(0), F.lit(1))
    block = F.pmod(F.xxhash64("kind", "ref"), F.coalesce(F.try_element_at(parts, F.col("level")), F.lit(1))).cast("int")
    (_dealt_postings(rows, level, block).sortWithinPartitions("term", "level", "part")
     .write.mode("overwrite").parquet(f"{path}/postings/segment={segment}"))
    written = spark.read.parquet(f"{path}/postings/segment={segment}")
    (written.groupBy("term", "level", "part").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("doc_len").alias("least"))
     .sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/blocks/segment={segment}"))
    total = (sum(r["n"] for r in levels), sum(r["len"] for r in levels))
    spark.createDataFrame([total], "n_docs long, all_len long").coalesce(1).write.mode("overwrite").parquet(f"{path}/size/segment={segment}")
    return segment


def stored_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, size) of all segments, for `search`."""
    size = spark.read.parquet(f"{path}/size").agg(F.sum("n_docs").alias("n_docs"), (F.sum("all_len") / F.sum("n_docs")).alias("avg_len"))
    return spark.read.parquet(f"{path}/postings"), size


def _tests(q: str) -> list[tuple[bool, Column]]:
    """For each word of a query: is it a prefix, and does a term fit it?"""
    return [(prefix, F.col("term").startswith(spark_fold(w)) if prefix else F.col("term") == spark_fold(w)) for w, prefix in parse_query(q)]


def search_stored(spark: SparkSession, path: str, q: str, limit: int = 10, lang: str | None = None, width: int = 16) -> tuple[DataFrame, int]:
    """FT3 on a stored index: the rows that `search` gives, and how many postings were scored for them.

    Blocks are taken from the highest bound down, `width` at first and four times as many in each round, until the
    last of the best scores so far is above the bound of all blocks that are left.
    """
    tests, k = _tests(q), clamp_limit(limit)
    postings, blocks = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/blocks")
    none = postings.select("kind", "ref", "lang", F.lit(0.0).alias("score")).limit(0)
    size = spark.read.parquet(f"{path}/size").agg(F.sum("n_docs").alias("n"), F.sum("all_len").alias("len")).first()
    if not tests or not size["n"]:
        return none, 0
    any_of = functools.reduce(lambda x, y: x | y, [test for _, test in tests])
    # a row may hold several terms that begin alike, so rows of a prefix are counted, those of a word are known
    seen = [postings.where(test).select("segment", "kind", "ref").distinct().count() if prefix else blocks.where(test).agg(F.sum("n")).first()[0] or 0
            for prefix, test in tests]
    idf = [max(math.log((size["n"] - n + 0.5) / (n + 0.5)), 1e-6) for n in seen]
    average = size["len"] / size["n"] or 1.0

    def score(hits: list[Column], length: Column) -> Column:
        norm = lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * length / average)
        return functools.reduce(lambda x, y: x + y, [w * tf * (lx.BM25_K1 + 1) / (tf + norm) for w, tf in zip(idf, hits)])

    def hits(count: str) -> list[Column]:
        return [F.sum(F.when(test, F.col(count)).otherwise(0)).alias(f"tf{i}") for i, (_, test) in enumerate(tests)]

    tfs = [F.col(f"tf{i}") for i in range(len(tests))]
    every = functools.reduce(lambda x, y: x & y, [tf > 0 for tf in tfs])
    key = ["segment", "level", "part"]
    bounds = cut_lineage(blocks.where(any_of).groupBy(*key).agg(*hits("most"), F.min("least").alias("least")).where(every)
                         .select(*key, score(tfs, F.col("least")).alias("bound")))
    order = lambda r: (-r["score"], r["kind"], r["ref"])
    best, read, above = [], 0, float("inf")
    while True:
        left = bounds.where(F.col("bound") < above)
        above, width = left.orderBy(F.desc("bound")).limit(width).agg(F.min("bound")).first()[0], 4 * width
        if above is None:
            break
        scored = (postings.where(any_of).join(left.where(F.col("bound") >= above).select(*key), key, "left_semi")
                  .groupBy("segment", "kind", "ref", "lang", "doc_len").agg(*hits("tf"), F.count("*").alias("postings")))
        seen_here = Observation()
        found = (scored.observe(seen_here, F.sum("postings").alias("n")).where(every if lang is None else every & (F.col("lang") == lang))
                 .select("kind", "ref", "lang", F.round(score(tfs, F.col("doc_len")), 6).alias("score")))
        # the best so far are no more rows than were asked for
        best = sorted([*best, *found.orderBy(F.desc("score"), "kind", "ref").limit(k).collect()], key=order)[:k]
        read += seen_here.get["n"] or 0
        rest = bounds.where(F.col("bound") < above).agg(F.max("bound")).first()[0]
        if rest is None or (len(best) == k and rest < best[-1]["score"] - 2e-6):
            break
    out = spark.createDataFrame(best, none.schema) if best else none
    return out.orderBy(F.desc("score"), "kind", "ref"), read


def spark_fold(word: str) -> str:
    """The same folding for a query word on the driver."""
    return word.lower().translate(str.maketrans(t.ACCENTED, t.BASE))


def highlight(body, words: list[tuple[str, bool]], size: int = 24) -> Column:
    """FT4: the first window of tokens with the most hits, hits in brackets, ellipsis where cut."""
    exact = [spark_fold(w) for w, prefix in words if not prefix]
    prefixes = [spark_fold(w) for w, prefix in words if prefix]
    pattern = "|".join([f"{re.escape(w)}(?![\\p{{L}}\\p{{N}}])" for w in exact]
                       + [re.escape(w) for w in prefixes])

    def window(tokens):
        flags = F.transform(tokens, lambda x: F.when(
            t.fold(x).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{pattern})"), 1).otherwise(0))
        return t.let(F.struct(tokens.alias("w"), flags.alias("f")), lambda v: t.let(
            F.array_max(F.transform(v["f"], lambda x, i: F.struct(
                F.aggregate(F.slice(v["f"], i + 1, F.lit(size)), F.lit(0), lambda a, y: a + y)
                .alias("n"), (-i).alias("minus")))), lambda best: F.concat(
                F.when(best["minus"] < 0, "…").otherwise(""),
                F.array_join(F.zip_with(F.slice(v["w"], 1 - best["minus"], F.lit(size)),
                                        F.slice(v["f"], 1 - best["minus"], F.lit(size)),
                                        lambda w, f: F.when(f == 1, F.concat(F.lit("["), w, F.lit("]")))
                                        .otherwise(w)), " "),
                F.when(F.size(v["w"]) > size - best["minus"], "…").otherwise(""))))
    return t.let(t.words(body), window)


def search_sales(addresses: DataFrame, parcels: DataFrame, sales: DataFrame, street: str | None = None,
                 section: str | None = None, nature: str | None = "Vente") -> DataFrame:
    """FT5: sales by street (accents and case ignored) and cadastre section."""
    out = sales if nature is None else sales.where(F.col("nature") == nature)
    if street:
        want = " ".join(re.sub("[^a-z0-9 ]+", " ", spark_fold(street)).split(" ")).strip()
        hit = addresses.where(t.plain("address").contains(want)).select("id_mutation").distinct()
        out = out.join(hit, "id_mutation", "left_semi")
    if section:
        hit = parcels.where(F.col("section") == section.upper()).select("id_mutation").distinct()
        out = out.join(hit, "id_mutation", "left_semi")
    return out


def meetings_between(meetings: DataFrame, date: str, first: str, last: str, limit: int | None = None) -> DataFrame:
    """FT6: meetings of a period, newest first."""
    found = meetings.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).orderBy(
        F.desc(date))
    return found if limit is None else found.limit(limit)


def meeting_items(items: DataFrame, meetings: DataFrame, meeting: str, date: str, day: str) -> DataFrame:
    """FT6: items of the meetings of a day."""
    on = meetings.where(F.to_date(date) == F.lit(day).cast("date")).select(meeting, date)
    return items.join(on, meeting)
