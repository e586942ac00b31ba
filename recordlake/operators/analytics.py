"""Roll-ups for readers: votes, money, rules, ledger, sales, history, watch lists, trials."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions import ids
from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.operators.running import running
from recordlake.operators.signals import vote_result_agg


# ---- pages ------------------------------------------------------------------------------------------

def page_needs_ocr(text: str, image_fraction: str) -> Column:
    """PF15: hardly any text, or an image-heavy page with little text."""
    n = F.length(F.regexp_replace(t.col(text), r"^\s+|\s+$", ""))
    return (n < lx.MIN_TEXT_CHARS) | ((F.col(image_fraction) >= lx.IMAGE_HEAVY_FRACTION)
                                      & (n < lx.IMAGE_HEAVY_MAX_CHARS))


def weak_ocr(mean_conf: str, low_fraction: str) -> Column:
    """PF15: recognised text that someone should look at."""
    return F.col(mean_conf).isNull() | (F.col(mean_conf) < 85) | (
        F.coalesce(F.col(low_fraction), F.lit(0.0)) > 0.15)


def ocr_stats(words: DataFrame, page: list[str], conf: str) -> DataFrame:
    """AG18: mean, minimum, share of words under 60, count."""
    return words.groupBy(*page).agg(
        F.round(F.avg(conf), 1).alias("mean_conf"), F.min(conf).alias("min_conf"),
        F.round(F.avg(F.when(F.col(conf) < 60, 1.0).otherwise(0.0)), 3).alias("low_word_fraction"),
        F.count("*").alias("words"))


# ---- votes and themes ----------------------------------------------------------------------------------

def vote_results(votes: DataFrame, item: str, kind: str, contrary: Column | None = None) -> DataFrame:
    """AG1: one result per item."""
    return votes.groupBy(item).agg(vote_result_agg(kind, contrary).alias("result"))


def votes_per_meeting(items: DataFrame, meeting: str, result: str, values: list[str]) -> DataFrame:
    """AG2: items per result."""
    return items.groupBy(meeting).agg(
        *[F.count_if(F.col(result) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def quarter(date) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def themes_by_quarter(items: DataFrame, topics: Column, date: str) -> DataFrame:
    """AG3 in long form: topic, quarter, n, with 'ALL' for the totals and 'undated' for items without a date.

    An item with several topics counts once in the row of all items, so that row has its own count.
    """
    q = F.coalesce(quarter(date), F.lit("undated")).alias("quarter")
    themes = items.select(q, F.explode(topics).alias("topic")).where(F.col("topic").isNotNull())
    themes = themes.rollup("topic", "quarter").agg(F.count("*").alias("n"), F.grouping("topic").alias("g")).where("g = 0").drop("g")
    everything = items.select(q).rollup("quarter").agg(F.count("*").alias("n")).select(
        F.lit("ALL").alias("topic"), "quarter", "n")
    # the only null quarters left are those of totals
    return themes.unionByName(everything).select("topic", F.coalesce("quarter", F.lit("ALL")).alias("quarter"), "n")


def themes_pivot(items: DataFrame, topics: Column, date: str, quarters: list[str]) -> DataFrame:
    """AG3 as the table readers see: a column for each quarter, for undated items and for the total, busiest
    theme first, and a row ALL of all items.  Quarters that are not listed count in the total only.
    """
    counts = themes_by_quarter(items, topics, date)
    columns = [F.max(F.when(F.col("quarter") == q, F.col("n"))).alias(name)
               for q, name in [*((q, q) for q in quarters), ("undated", "undated"), ("ALL", "total")]]
    return counts.groupBy("topic").agg(*columns).orderBy(F.desc("total"), "topic")


# ---- money ------------------------------------------------------------------------------------------------

def has_euros() -> Column:
    return F.exists("amounts", lambda a: a["kind"] == "eur")


def money_items(items: DataFrame) -> DataFrame:
    """Items about money that may be shown."""
    return items.where(~F.col("sensitive") & has_euros())


def basis() -> Column:
    """AG5: the rules cited, else 'rule wording only', else 'none stated'."""
    def stated(v):
        keys = F.array_join(F.array_distinct(v["keys"]), "; ")
        return (F.when(F.size(v["keys"]) > 0, F.concat(F.lit("cites: "), keys))
                .when(v["words"] > 0, "rule wording only").otherwise("none stated"))
    return t.let(F.struct(F.col("refs.key").alias("keys"), F.size("wording").alias("words")), stated)


def finance_summary(items: DataFrame, *by: Column) -> DataFrame:
    """AG4: how much the minutes say about the rules behind money."""
    money = ~F.col("sensitive") & has_euros()
    cites, words = F.size("refs") > 0, F.size("wording") > 0
    return items.groupBy(*by).agg(
        F.count("*").alias("items"), F.count_if(money).alias("with_money"),
        F.count_if(money & cites).alias("cited"), F.count_if(money & ~cites & words).alias("worded"),
        F.count_if(money & ~cites & ~words).alias("silent"),
        F.count_if(money & (F.size("exceptions") > 0)).alias("exceptional"))


def money_by_year(rows: DataFrame, date: str, value: str, *extra: Column) -> DataFrame:
    """AG6: totals per year; the rows themselves stay rows."""
    cents = F.col(value).cast("decimal(18,2)")
    return rows.groupBy(F.year(date).cast("bigint").alias("year")).agg(
        F.count("*").alias("n"), F.sum(cents).cast("double").alias("total"),
        F.max(value).alias("largest"), *extra)


def rules_cited(items: DataFrame) -> DataFrame:
    """AG7: per reference: items that cite it, distinct dates, first and last date."""
    refs = items.select("date", F.explode(F.array_distinct(F.col("refs.key"))).alias("key"))
    return refs.groupBy("key").agg(
        F.count("*").alias("items"), F.count_distinct("date").alias("dates"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"))


def exceptions_list(items: DataFrame) -> DataFrame:
    """AG8: first exception of each item, how many there are, and the basis stated beside it."""
    return items.where(~F.col("sensitive") & (F.size("exceptions") > 0)).select(
        "item_id", "date", F.get("exceptions", F.lit(0))["marker"].alias("marker"),
        F.get("exceptions", F.lit(0))["sentence"].alias("sentence"),
        F.size("exceptions").alias("mentions"), basis().alias("basis"))


# ---- ledger -----------------------------------------------------------------------------------------------

def main_budget(rows: DataFrame) -> DataFrame:
    """PF12: final rows of the main budget, in either layout of the source."""
    final = F.col("bal").isNull() | (F.col("bal") == "DEF")
    return rows.where(final & F.when(F.col("budget").isNotNull(), F.col("budget") == "BP")
                      .otherwise(F.col("cbudg") == "1"))


def _covers(account: str, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(account).startswith(p)
    return out


def ledger_rollup(rows: DataFrame, rules=None) -> DataFrame:
    """AG9: headline figures per year in whole euros, banker's rounding as in the published tables.

    One pass with conditional sums: the rule table has a handful of rows.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    debit, credit = F.coalesce("sd", zero), F.coalesce("sc", zero)
    flow = F.coalesce("obnetdeb", zero) - F.coalesce("obnetcre", zero)
    sides = {"credit": credit - debit, "debit": debit - credit, "flow": flow}
    sums = [F.bround(F.coalesce(F.sum(F.when(_covers("compte", into) & ~_covers("compte", out),
                                             sides[side])), zero), 0).cast("bigint").alias(name)
            for name, side, into, out in (rules or lx.LEDGER_RULES)]
    return (main_budget(rows).groupBy("year").agg(*sums, F.min("nomen").alias("nomenclature"))
            .withColumn("result", F.col("revenue") - F.col("spending")))


# ---- sales --------------------------------------------------------------------------------------------------

def sales_by_mutation(rows: DataFrame, order: str) -> DataFrame:
    """AG10: one row per sale.  Sets of addresses, parcels and types are separate tables, see below; join
    them with a left join, since a sale may have none.

    Built area and rooms count for rows with a building type, land for rows without; date, nature and
    price come from the first row in reading order.
    """
    typed = F.coalesce("type_local", F.lit("")) != ""
    first = F.min_by(F.struct("date_mutation", "nature_mutation", "valeur_fonciere"), F.col(order))
    return (rows.groupBy("id_mutation").agg(
        first.alias("h"),
        F.sum(F.when(typed, F.coalesce("surface_reelle_bati", F.lit(0.0))).otherwise(0.0)).alias("built"),
        F.sum(F.when(typed, F.coalesce("nombre_pieces_principales", F.lit(0))).otherwise(0)).alias("rooms"),
        F.sum(F.when(~typed, F.coalesce("surface_terrain", F.lit(0.0))).otherwise(0.0)).alias("land"))
        .select("id_mutation", F.col("h.date_mutation").alias("date"),
                F.col("h.nature_mutation").alias("nature"),
                F.coalesce("h.valeur_fonciere", F.lit(0.0)).alias("price"), "built", "rooms", "land"))


def sale_parcels(rows: DataFrame) -> DataFrame:
    """Distinct (sale, section, number)."""
    return (rows.select("id_mutation", ids.parcel_key("id_parcelle").alias("p"))
            .where(F.col("p").isNotNull()).select("id_mutation", "p.section", "p.number").distinct())


def sale_addresses(rows: DataFrame) -> DataFrame:
    """Distinct (sale, address)."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in
             ("adresse_numero", "adresse_suffixe", "adresse_nom_voie")]
    return rows.select("id_mutation", F.concat_ws(" ", *parts).alias("address")).where(
        "address <> ''").distinct()


def sale_types(rows: DataFrame) -> DataFrame:
    """Distinct (sale, type) of buildings."""
    return rows.where("type_local <> ''").select("id_mutation", F.col("type_local").alias("type")).distinct()


# ---- history ---------------------------------------------------------------------------------------------------

def history_by_year(meetings: DataFrame, date: str, pages: str, chair: str, amounts: str,
                    topics: DataFrame, k: int = 4) -> DataFrame:
    """AG16: per year: meetings, pages, distinct chairs, amount mentions and the k busiest topics.

    ``topics`` has (date, topic, hits); years and topics are few, so the top k ranks small rows.
    """
    year = F.year(date).cast("bigint").alias("year")
    base = meetings.groupBy(year).agg(
        F.count("*").alias("meetings"), F.sum(pages).cast("bigint").alias("pages"),
        F.count_distinct(chair).alias("chairs"), F.sum(amounts).cast("bigint").alias("amount_mentions"))
    hits = topics.groupBy(year, "topic").agg(F.sum("hits").alias("hits"))
    ranked = hits.withColumn("r", F.row_number().over(
        Window.partitionBy("year").orderBy(F.desc("hits"), "topic"))).where(F.col("r") <= k)
    top = ranked.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("r", "topic"))), lambda x: x["topic"]), ", ").alias("top_topics"))
    return base.join(top, "year", "left")


def watch_topics(items: DataFrame, topic: str, date: str, days: int = lx.WATCH_DAYS,
                 approximate: bool = False) -> DataFrame:
    """AG21: per topic: items and meetings in the days before the latest date, and the last date."""
    latest = items.agg(F.max(F.to_date(date)).alias("latest")).scalar()
    recent = F.to_date(date) >= F.date_sub(latest, days)
    when = F.when(recent, F.to_date(date))
    meetings = F.approx_count_distinct(when) if approximate else F.count_distinct(when)
    return items.groupBy(topic).agg(
        F.count_if(recent).alias("items_recent"), meetings.alias("meetings_recent"),
        F.date_format(F.max(F.to_date(date)), "yyyy-MM-dd").alias("last"))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """TK2 and others: k rows per group.  Spark limits each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


# ---- trials and costs -------------------------------------------------------------------------------------------

def trial_report(rows: DataFrame, by: list[str], checks: list[str], seconds: str, tokens: str, chunk: Column | None = None
                 ) -> DataFrame:
    """AG24: per model and language: passes per check and of all checks, upper median seconds, tokens.

    The median is the first value up to which more rows have come than half of them; what comes before a value is
    added up in chunks (``chunk`` must not fall as the seconds rise; whole seconds by default), so no group is one task's.
    """
    passed = F.lit(True)
    for c in checks:
        passed = passed & F.coalesce(F.col(c), F.lit(False))
    # The upper median is the value at position n div 2 counted from 0.
    counted = rows.groupBy(*by, seconds).agg(
        F.count("*").alias("n"), F.sum(tokens).alias("tok"), F.count_if(passed).alias("all_ok"),
        *[F.count_if(F.col(c)).alias(c) for c in checks])
    ranked = running(counted, by, F.floor(F.col(seconds)) if chunk is None else chunk, [seconds], sums={"upto": F.col("n")})
    whole = counted.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in checks], F.sum("all_ok").alias("all_ok"),
                                     F.sum("tok").cast("bigint").alias("tokens"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}"))
    median = (ranked.select(*by, seconds, "upto").alias("r").join(whole.select(*by, F.col("n").alias("_all")).alias("w"), same)
              .where(F.col("r.upto") > F.expr("_all div 2"))
              .groupBy(*[F.col(f"r.{k}").alias(k) for k in by]).agg(F.min(f"r.{seconds}").alias("median_seconds")))
    match = F.lit(True)
    for k in by:
        match = match & F.col(f"w.{k}").eqNullSafe(F.col(f"m.{k}"))
    return whole.alias("w").join(median.alias("m"), match, "left").select(
        *[F.col(f"w.{k}").alias(k) for k in by], "w.n", *[F.col(f"w.{c}").alias(c) for c in checks], "w.all_ok", "m.median_seconds", "w.tokens")


def cost_estimate(docs: DataFrame, text: str, price_in: float, price_out: float,
                  *by: str, chars_per_token: float = 3.2) -> DataFrame:
    """AG25: tokens and USD (per million) for sending every text and getting as much back."""
    chars = F.sum(F.length(text))
    tokens = F.floor(chars / chars_per_token)
    return docs.groupBy(*by).agg(
        F.count("*").alias("texts"), chars.alias("chars"), tokens.alias("tokens"),
        F.round(tokens * price_in / 1e6, 6).alias("usd_in"),
        F.round(tokens * price_out / 1e6, 6).alias("usd_out"))


def group_decisions(rows: DataFrame, topics: Column, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """AG26: a row under every group one of its topics belongs to."""
    def touches(names):
        return F.exists(topics, lambda x: x.isin(names))
    member = F.array(*[F.struct(F.lit(g).alias("group"), touches(ts).alias("in"))
                       for g, ts in groups])
    return rows.withColumn("g", F.explode(F.filter(member, lambda m: m["in"]))).withColumn(
        "group", F.col("g.group")).drop("g")


def zone_counts(rows: DataFrame, kind: str, label: str) -> DataFrame:
    """AG20."""
    return rows.groupBy(kind, label).agg(F.count("*").alias("n"))


def heritage_filter(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """AG20: rows whose text matches a lexicon."""
    return rows.where(F.col(text).rlike(pattern))


def first_non_empty(*columns: str) -> Column:
    """PF13: the first field that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def later_dates_within(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Distinct dates per key with how many come later and the next one."""
    days = rows.select(*keys, F.to_date(date).alias("day")).distinct()
    back = Window.partitionBy(*keys).orderBy(F.desc("day"))
    return days.select(*keys, "day", (F.row_number().over(back) - 1).cast("bigint").alias("later"),
                       F.lag("day").over(back).alias("next_day"))
