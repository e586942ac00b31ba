"""Digests composed of the other operators (DG1, DG2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import scan
from recordlake.functions import text as t
from recordlake.operators import analytics as an
from recordlake.operators import signals as sg


def archive_digest(pages: DataFrame, mask=None, context_chars: int | None = None,
                   quote_chars: int | None = None) -> DataFrame:
    """DG2: vote sentences of old minutes with the sentence before; sales are counted, not quoted.

    The context is the previous sentence of the same page, so everything happens inside the row.
    """
    mask = mask or (lambda c: c)
    split = sg.with_sentences(pages).withColumn("marked", t.settled(scan.marked(F.col("sentences"), *sg.VOTE_PARTS)))
    located = F.transform("marked", lambda x: F.struct(
        x["s"].alias("sentence"), F.when(x["at"] > 0, F.get("sentences", x["at"] - 1)).otherwise("").alias("before"), sg.vote(x).alias("vote")))
    found = F.filter(located, lambda x: x["vote"]["kind"].isNotNull())
    keep = [c for c in pages.columns if c != "text"]
    rows = split.select(*keep, t.settled(found).alias("found")).select(*keep, F.explode("found").alias("d"))
    sale = F.concat_ws(" ", "d.before", "d.sentence").rlike(t.uni(lx.SALE_MARKERS))
    return rows.select(
        *keep, sale.alias("sale"), F.col("d.vote.kind").alias("kind"),
        F.when(~sale, _cut(mask(F.col("d.before")), context_chars, t.tail_words)).alias("context"),
        F.when(~sale, _cut(mask(F.col("d.sentence")), quote_chars, t.head_words)).alias("sentence"))


def _cut(text, chars: int | None, how):
    return text if chars is None else how(text, chars)


def whats_new(items: DataFrame, threads: DataFrame, recent: int = 3, scan: int = 5,
              quote_chars: int | None = None) -> DataFrame:
    """DG1 as one long table (section, date, title, detail).

    ``items`` has date, title, sensitive, sentences and followups; ``threads`` has title, last and
    possibly_dropped.  Only the few latest meetings are read in full.  Threads with a ``status`` that were seen again at
    one of the latest meetings come ``back``, with the number of their meetings (``n_meetings``); where items have
    ``topics``, each watched topic says how many items and meetings it had in the year before the latest meeting.
    """
    shown = items.where(~F.col("sensitive"))
    dates = items.select("date").distinct().orderBy(F.desc("date"))
    newest, searched = dates.limit(recent), dates.limit(scan)
    decisions = shown.join(F.broadcast(newest), "date", "left_semi").select(
        F.lit("decision").alias("section"), "date", "title", F.lit("").alias("detail"))
    near = shown.join(F.broadcast(searched), "date", "left_semi")
    pending = near.select("date", "title", F.explode("followups").alias("f")).where(
        F.col("f.type").isin("deferred", "planned")).select(
        F.lit("pending").alias("section"), "date", "title", _cut(F.col("f.sentence"), quote_chars, t.clip).alias("detail"))
    prose = F.filter("sentences", lambda s: (t.digit_share(s) <= 0.15) & t.looks_like_prose(s))
    mentioned = near.select("date", "title", F.explode(
        sg.mentioned_dates(prose, F.col("date"))).alias("m"))
    # The same date in the same wording is shown once: the earliest meeting wins.
    first = mentioned.groupBy(F.col("m.mentioned").alias("day"),
                              F.col("m.sentence").alias("wording")).agg(
        F.min_by(F.struct("date", "title"), F.struct("date", "title")).alias("x"))
    upcoming = first.select(F.lit("date").alias("section"), F.col("x.date").alias("date"),
                            F.col("x.title").alias("title"),
                            F.date_format("day", "yyyy-MM-dd").alias("detail"))
    dropped = threads.where("possibly_dropped").select(
        F.lit("dropped").alias("section"), F.col("last").alias("date"), "title",
        F.lit("").alias("detail"))
    out = decisions.unionByName(pending).unionByName(upcoming).unionByName(dropped)
    if "status" in threads.columns:
        back = threads.where(F.col("status") != "one-off").join(F.broadcast(newest.withColumnRenamed("date", "last")), "last", "left_semi")
        out = out.unionByName(back.select(F.lit("back").alias("section"), F.col("last").alias("date"), "title", F.col("n_meetings").cast("string").alias("detail")))
    if "topics" in items.columns:
        latest = items.agg(F.max("date").alias("d")).scalar()
        named = shown.select("date", F.explode("topics").alias("topic")).where(~F.col("topic").isin(lx.UNWATCHED_TOPICS))
        when = F.when(F.col("date") >= F.date_sub(latest, lx.WATCH_DAYS), F.col("date"))
        watch = named.groupBy("topic").agg(F.max("date").alias("date"), F.count(when).alias("n"), F.count_distinct(when).alias("m"))
        out = out.unionByName(watch.select(F.lit("watch").alias("section"), "date", F.col("topic").alias("title"), F.concat_ws("/", "n", "m").alias("detail")))
    return out
