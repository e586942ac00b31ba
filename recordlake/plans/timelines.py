"""Queries over windows, roll-ups, top-k and set operations (WN*, AG*, TK*, SO*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import ids
from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.operators import analytics as an
from recordlake.operators import timeline as tl
from recordlake.operators import sets as st
from recordlake.plans.catalog import query, table
from recordlake.plans.structure import sql_sentences


def day():
    return F.date_trunc("day", F.col("ts"))


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def orders(spark, folder):
    return table(spark, folder, "orders")


@query("wn1_eras", """WITH l AS (SELECT *, lag(event_type) OVER w AS p FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 e AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END)
   OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM l)
 SELECT user_id, CAST(era AS BIGINT) AS era, event_type, min_by(event_id, ts) AS first_id,
  max_by(event_id, ts) AS last_id, count(*) AS n FROM e GROUP BY user_id, era, event_type""")
def wn1(spark, folder):
    e = tl.eras(events(spark, folder), ["user_id"], ["ts", "event_id"], "event_type", day())
    return e.select("user_id", "era", "event_type", F.col("start.event_id").alias("first_id"),
                    F.col("end.event_id").alias("last_id"), "n")


@query("wn2_gaps", """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS a FROM orders),
 g AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a) AS b FROM d)
 SELECT o_custkey, strftime(a, '%Y-%m-%d') AS after, strftime(b, '%Y-%m-%d') AS before,
  CAST(b - a AS INT) AS days FROM g WHERE b - a > 180""")
def wn2(spark, folder):
    g = tl.gaps(orders(spark, folder), ["o_custkey"], "o_orderdate", 180)
    return g.select("o_custkey", F.date_format("after", "yyyy-MM-dd").alias("after"),
                    F.date_format("before", "yyyy-MM-dd").alias("before"), "days")


@query("wn3_missing_years", """WITH y AS (SELECT o_custkey, min(year(o_orderdate)) AS lo,
   max(year(o_orderdate)) AS hi FROM orders GROUP BY 1),
 m AS (SELECT o_custkey, unnest(range(lo, hi + 1)) AS yr FROM y
   EXCEPT SELECT o_custkey, year(o_orderdate) FROM orders),
 i AS (SELECT *, yr - row_number() OVER (PARTITION BY o_custkey ORDER BY yr) AS g FROM m)
 SELECT o_custkey, CASE WHEN min(yr) = max(yr) THEN CAST(min(yr) AS VARCHAR)
   ELSE min(yr) || '–' || max(yr) END AS years FROM i GROUP BY o_custkey, g""")
def wn3(spark, folder):
    m = tl.missing_ranges(orders(spark, folder), ["o_custkey"], F.year("o_orderdate"))
    return m.select("o_custkey", tl.range_label("first", "last").alias("years"))


@query("wn4_unique_names", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') ||
  CASE WHEN row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1 THEN ''
   ELSE '-' || o_orderkey END AS name FROM orders""")
def wn4(spark, folder):
    return tl.unique_names(orders(spark, folder), "o_orderdate", "o_orderkey").select(
        "o_orderkey", "name")


@query("wn5_version_chain", """WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id
   ORDER BY ts, event_id) AS p FROM events),
 k AS (SELECT * FROM c WHERE p IS DISTINCT FROM event_type)
 SELECT user_id, event_id, event_type,
  row_number() OVER w AS version, lead(ts) OVER w IS NULL AS is_current,
  epoch_us(lead(ts) OVER w) AS superseded_us FROM k
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def wn5(spark, folder):
    v = tl.version_chain(events(spark, folder), ["user_id"], ["ts", "event_id"], "event_type", day())
    return v.select("user_id", "event_id", "event_type", "version", "is_current",
                    F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', superseded_at)")
                    .alias("superseded_us"))


@query("wn6_later_mentions", """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
 r AS (SELECT *, row_number() OVER w - 1 AS later, lag(day) OVER w AS nxt FROM d
   WINDOW w AS (PARTITION BY o_custkey ORDER BY day DESC)),
 m AS (SELECT DISTINCT day FROM d), a AS (SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS after FROM m)
 SELECT o_orderkey, r.later, strftime(r.nxt, '%Y-%m-%d') AS next_day, a.after AS meetings_after
 FROM orders o JOIN r ON o.o_custkey = r.o_custkey AND CAST(o.o_orderdate AS DATE) = r.day
 JOIN a ON a.day = r.day WHERE o_orderstatus = 'P'""")
def wn6(spark, folder):
    m = tl.later_mentions(orders(spark, folder), ["o_custkey"], "o_orderdate",
                          F.col("o_orderstatus") == "P")
    return m.select("o_orderkey", "later", F.date_format("next_day", "yyyy-MM-dd").alias("next_day"),
                    F.col("later_meetings").alias("meetings_after"))


@query("wn7_sentence_context", """SELECT conv_id, turn, lag(text, 1, '') OVER (PARTITION BY conv_id
  ORDER BY turn) AS before FROM conversations""")
def wn7(spark, folder):
    return tl.previous_text(table(spark, folder, "conversations"), ["conv_id"], "turn", "text").select(
        "conv_id", "turn", F.col("prev_text").alias("before"))


@query("wn8_after_flag", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
   FROM events),
 m AS (SELECT *, max(CASE WHEN event_type = 'error' THEN i END) OVER w AS h,
   max(CASE WHEN event_type NOT IN ('view', 'click') THEN i END) OVER w AS s FROM p
   WINDOW w AS (PARTITION BY user_id ORDER BY i))
 SELECT event_id, h IS NOT NULL AND h >= coalesce(s, 0) AS flag FROM m""")
def wn8(spark, folder):
    return tl.carried_flag(events(spark, folder), ["user_id"], ["ts", "event_id"],
                           F.col("event_type") == "error",
                           F.col("event_type").isin("view", "click"), day()).select("event_id", "flag")


@query("wn9_dedupe_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def wn9(spark, folder):
    return tl.dedupe_keep_first(table(spark, folder, "documents"), [ids.content_hash("text")],
                                "doc_id").select("doc_id")


@query("wn10_sample_per_category", """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (
  PARTITION BY lang ORDER BY sha256('trial|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 7""")
def wn10(spark, folder):
    return tl.sample_per_category(table(spark, folder, "documents").select("doc_id", "lang"),
                                  "lang", "doc_id", 7, "trial")


@query("wn11_pack_batches", f"""WITH RECURSIVE s AS (SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS i,
   length(unnest(l)) AS n FROM (SELECT doc_id, {sql_sentences('text')} AS l FROM documents)),
 w(doc_id, i, batch, k, size) AS (
  SELECT doc_id, i, 1, 1, n FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN w.size + s.n > 600 OR w.k >= 12 THEN w.batch + 1 ELSE w.batch END,
   CASE WHEN w.size + s.n > 600 OR w.k >= 12 THEN 1 ELSE w.k + 1 END,
   CASE WHEN w.size + s.n > 600 OR w.k >= 12 THEN s.n ELSE w.size + s.n END
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
 SELECT doc_id, batch, count(*) AS segments FROM w GROUP BY doc_id, batch""")
def wn11(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", t.sentences("text").alias("s"))
    return d.select("doc_id", F.explode(tl.pack_batches(F.col("s"), 600, 12)).alias("batch")).groupBy(
        "doc_id", "batch").agg(F.count("*").alias("segments"))


@query("wn12_item_ordinals", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
  min(l_partkey) OVER (PARTITION BY l_orderkey) AS first_page,
  max(l_partkey) OVER (PARTITION BY l_orderkey) AS last_page FROM lineitem""")
def wn12(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                 "l_suppkey", "l_extendedprice")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = tl.ordinals(li, ["l_orderkey"], order, F.col("l_linenumber"))
    return numbered.join(tl.page_span(li, ["l_orderkey"], "l_partkey"), "l_orderkey").drop(
        "l_extendedprice")


@query("wn13_sliding_count", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS hits,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM events""")
def wn13(spark, folder):
    return tl.sliding_count(events(spark, folder), ["user_id"], "ts", 6 * 3600, 3).select(
        "event_id", "hits", "over_limit")


@query("wn14_running_spend", """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (
  ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey
   ROWS UNBOUNDED PRECEDING) > 100000000 AS over_cap FROM orders""")
def wn14(spark, folder):
    return tl.running_spend(orders(spark, folder).select("o_orderkey", "o_orderdate", "o_totalprice"),
                            ["o_orderdate", "o_orderkey"], F.col("o_totalprice"), 100000000).select("o_orderkey", "spent", "over_cap")


# ---- aggregations ---------------------------------------------------------------------------------------

@query("ag1_vote_result", """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'rejected'
  WHEN bool_or(l_returnflag = 'A' OR l_discount > 0.09) THEN 'majority' ELSE 'unanimous' END AS result
 FROM lineitem GROUP BY l_orderkey""")
def ag1(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_discount")
    kind = (F.when(F.col("l_returnflag") == "R", "rejected")
            .when(F.col("l_returnflag") == "A", "majority").otherwise("unanimous"))
    return an.vote_results(li.withColumn("kind", kind), "l_orderkey", "kind",
                           F.col("l_discount") > 0.09)


@query("ag2_votes_per_meeting", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS "n_O",
  count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'P') AS "n_P",
  count(*) AS total FROM orders GROUP BY o_custkey""")
def ag2(spark, folder):
    return an.votes_per_meeting(orders(spark, folder), "o_custkey", "o_orderstatus", ["O", "F", "P"])


@query("ag3_themes_by_quarter", """SELECT coalesce(topic, 'ALL') AS topic, coalesce(q, 'ALL') AS quarter, count(*) AS n
 FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS topic,
   year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q FROM orders)
 GROUP BY GROUPING SETS ((topic, q), (topic))
 UNION ALL SELECT 'ALL', coalesce(q, 'ALL'), count(*) FROM (
   SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q FROM orders) GROUP BY ROLLUP (q)""")
def ag3(spark, folder):
    return an.themes_by_quarter(orders(spark, folder),
                                F.array("o_orderpriority", "o_orderstatus"), "o_orderdate")


QUARTERS = [f"{y}-Q{q}" for y in range(1992, 1999) for q in (1, 2, 3, 4)]
SQL_QUARTERS = ", ".join(f"""nullif(count(*) FILTER (q = '{q}'), 0) AS "{q}\"""" for q in QUARTERS)


@query("ag3_themes_pivot", f"""WITH r AS (SELECT o_orderpriority AS topic,
   year(d) || '-Q' || quarter(d) AS q FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS d FROM orders)),
 a AS (SELECT topic, q FROM r UNION ALL SELECT 'ALL', q FROM r)
 SELECT topic, {SQL_QUARTERS}, nullif(count(*) FILTER (q IS NULL), 0) AS undated, count(*) AS total FROM a GROUP BY 1""")
def ag3_pivot(spark, folder):
    some = orders(spark, folder).withColumn("d", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    return an.themes_pivot(some, F.array("o_orderpriority"), "d", QUARTERS)


@query("ag6_money_by_year", """SELECT year(o_orderdate) AS year, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS largest,
  count(*) FILTER (o_totalprice > 300000) AS large FROM orders GROUP BY 1""")
def ag6(spark, folder):
    return an.money_by_year(orders(spark, folder), "o_orderdate", "o_totalprice",
                            F.count_if(F.col("o_totalprice") > 300000).alias("large"))


# A ledger made of every lineitem row: the account comes from its keys, debit and credit from prices.
LEDGER_SQL = """SELECT year(l_shipdate) AS year,
  concat(cast(array(7031,6411,7311,66111,74121,775,1641,165,2315,2128,6811,676)[cast(l_partkey % 12 AS int)] AS string),
         cast(l_linenumber AS string)) AS compte,
  cast(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS decimal(18,2)) AS sd,
  cast(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END AS decimal(18,2)) AS sc,
  cast(l_quantity AS decimal(18,2)) AS obnetdeb, cast(l_discount AS decimal(18,2)) AS obnetcre,
  CASE WHEN l_suppkey % 9 = 0 THEN 'PREV' WHEN l_suppkey % 2 = 0 THEN 'DEF' END AS bal,
  CASE WHEN year(l_shipdate) < 2000 THEN 'M14' ELSE 'M57' END AS nomen,
  CASE WHEN year(l_shipdate) < 2000 THEN CASE l_linestatus WHEN 'O' THEN 'BP' ELSE 'BA' END END AS budget,
  CASE WHEN year(l_shipdate) >= 2000 THEN CASE l_linestatus WHEN 'O' THEN '1' ELSE '3' END END AS cbudg
 FROM {lineitem}"""
SQL_LEDGER = LEDGER_SQL.replace("{lineitem}", "lineitem").replace(
    "array(", "list_value(").replace("[cast(l_partkey % 12 AS int)]", "[cast(l_partkey % 12 AS int) + 1]").replace(
    "concat(cast(list_value", "concat(cast((list_value").replace("+ 1] AS string)", "+ 1]) AS string)")
SQL_MAIN = ("(bal IS NULL OR bal = 'DEF') AND CASE WHEN budget IS NOT NULL THEN budget = 'BP' "
            "ELSE coalesce(cbudg = '1', false) END")


def _sql_rule(side, into, out):
    cond = "(" + " OR ".join(f"compte LIKE '{p}%'" for p in into) + ")"
    for p in out:
        cond += f" AND compte NOT LIKE '{p}%'"
    value = {"credit": "sc - sd", "debit": "sd - sc", "flow": "obnetdeb - obnetcre"}[side]
    return f"CAST(round_even(CAST(coalesce(sum(CASE WHEN {cond} THEN {value} END), 0) AS DECIMAL(18,2)), 0) AS BIGINT)"


def ledger(spark, folder):
    return spark.sql(LEDGER_SQL, lineitem=table(spark, folder, "lineitem"))


@query("ag9_ledger_rollup", f"""WITH l AS ({SQL_LEDGER}), r AS (SELECT year,
 {', '.join(f'{_sql_rule(s, i, o)} AS {n}' for n, s, i, o in lx.LEDGER_RULES)}, min(nomen) AS nomenclature
 FROM l WHERE {SQL_MAIN} GROUP BY year) SELECT *, revenue - spending AS result FROM r""")
def ag9(spark, folder):
    return an.ledger_rollup(ledger(spark, folder).withColumn("year", F.col("year").cast("bigint")))


@query("pf12_main_budget", f"""WITH l AS ({SQL_LEDGER}) SELECT year, compte, CAST(sd AS DOUBLE) AS sd,
  CAST(sc AS DOUBLE) AS sc FROM l WHERE {SQL_MAIN}""")
def pf12(spark, folder):
    return an.main_budget(ledger(spark, folder)).select(
        F.col("year").cast("bigint").alias("year"), "compte", F.col("sd").cast("double").alias("sd"),
        F.col("sc").cast("double").alias("sc"))


# Sales rows made of lineitem: a sale is an order, a parcel comes from the part.
SALES_SQL = """SELECT cast(l_orderkey AS string) AS id_mutation, to_date(l_shipdate) AS date_mutation,
  CASE l_returnflag WHEN 'R' THEN 'Echange' ELSE 'Vente' END AS nature_mutation,
  l_extendedprice AS valeur_fonciere, cast(l_linenumber AS string) AS adresse_numero,
  CASE WHEN l_suppkey % 5 = 0 THEN 'B' END AS adresse_suffixe,
  concat('RUE ', cast(l_suppkey % 17 AS string)) AS adresse_nom_voie,
  concat('99001000', CASE WHEN l_suppkey % 2 = 0 THEN 'AB' ELSE '0C' END,
         lpad(cast(l_partkey % 10000 AS string), 4, '0')) AS id_parcelle,
  CASE l_linestatus WHEN 'O' THEN 'Maison' ELSE '' END AS type_local,
  l_quantity AS surface_reelle_bati, cast(l_linenumber AS int) AS nombre_pieces_principales,
  l_quantity * 2 AS surface_terrain,
  struct(l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no
 FROM {lineitem}"""


def sales(spark, folder):
    return spark.sql(SALES_SQL, lineitem=table(spark, folder, "lineitem"))


@query("ag10_sales_by_mutation", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
   ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
 a AS (SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation,
  max(CASE WHEN n = 1 THEN strftime(l_shipdate, '%Y-%m-%d') END) AS date,
  max(CASE WHEN n = 1 THEN CASE l_returnflag WHEN 'R' THEN 'Echange' ELSE 'Vente' END END) AS nature,
  max(CASE WHEN n = 1 THEN l_extendedprice END) AS price,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS built,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS BIGINT) AS rooms,
  sum(CASE WHEN l_linestatus <> 'O' THEN l_quantity * 2 ELSE 0.0 END) AS land,
  count(DISTINCT (l_suppkey % 2, l_partkey % 10000)) FILTER (l_orderkey % 7 <> 0) AS parcels,
  count(DISTINCT (l_linenumber, l_suppkey % 5 = 0, l_suppkey % 17)) FILTER (l_orderkey % 5 <> 0) AS addresses,
  count(DISTINCT l_linestatus) FILTER (l_linestatus = 'O') AS types FROM r GROUP BY 1)
 SELECT * FROM a""")
def ag10(spark, folder):
    rows = sales(spark, folder)
    sale = F.col("id_mutation").cast("bigint")
    rows = rows.withColumn("id_parcelle", F.when(sale % 7 != 0, F.col("id_parcelle"))).withColumns({
        c: F.when(sale % 5 != 0, F.col(c)) for c in ("adresse_numero", "adresse_suffixe", "adresse_nom_voie")})
    out = an.sales_by_mutation(rows, "row_no")
    for name, table_of in (("parcels", an.sale_parcels), ("addresses", an.sale_addresses), ("types", an.sale_types)):
        out = out.join(table_of(rows).groupBy("id_mutation").agg(F.count("*").alias(name)), "id_mutation", "left")
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd")).fillna(0, ["parcels", "addresses", "types"])


@query("ag16_history_by_year", """WITH b AS (SELECT year(o_orderdate) AS year, count(*) AS meetings,
   CAST(sum(o_orderkey % 7) AS BIGINT) AS pages, count(DISTINCT o_custkey) AS chairs,
   CAST(sum(o_orderkey % 3) AS BIGINT) AS amount_mentions FROM orders GROUP BY 1),
 h AS (SELECT year(o_orderdate) AS year, o_orderpriority AS topic, sum(o_orderkey % 5 + 1) AS hits
   FROM orders GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY hits DESC, topic) AS r FROM h)
 SELECT b.*, (SELECT string_agg(topic, ', ' ORDER BY r.r) FROM r WHERE r.year = b.year AND r.r <= 4)
  AS top_topics FROM b""")
def ag16(spark, folder):
    o = orders(spark, folder).withColumns({"p": F.col("o_orderkey") % 7, "a": F.col("o_orderkey") % 3})
    topics = o.select("o_orderdate", F.col("o_orderpriority").alias("topic"),
                      (F.col("o_orderkey") % 5 + 1).alias("hits"))
    return an.history_by_year(o, "o_orderdate", "p", "o_custkey", "a", topics)


@query("ag17_meeting_profile", r"""WITH n AS (SELECT doc_id, TRY_CAST(unnest(regexp_extract_all(text, '\d+')) AS BIGINT) AS v
   FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) AS r FROM n WHERE v IS NOT NULL),
 g AS (SELECT doc_id, count(*) AS numbers,
   string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS largest FROM r GROUP BY 1)
 SELECT d.doc_id, length(text) AS characters, len(string_split(text, chr(10))) AS lines,
  coalesce(g.numbers, 0) AS numbers, coalesce(g.largest, '') AS largest
 FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""")
def ag17(spark, folder):
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1),
                                 lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    d = table(spark, folder, "documents").select("doc_id", "text", F.sort_array(found, False).alias("v"))
    return d.select(
        "doc_id", F.length("text").cast("bigint").alias("characters"),
        F.size(F.split("text", "\n")).cast("bigint").alias("lines"),
        F.size("v").cast("bigint").alias("numbers"),
        F.array_join(F.transform(F.slice("v", 1, 3), lambda x: x.cast("string")), ",").alias("largest"))


@query("ag18_ocr_stats", """SELECT user_id, round(avg(value), 1) AS mean_conf, min(value) AS min_conf,
  round(avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END), 3) AS low_word_fraction, count(*) AS words
 FROM events GROUP BY user_id""")
def ag18(spark, folder):
    return an.ocr_stats(events(spark, folder), ["user_id"], "value")


@query("ag20_zone_counts", """SELECT p_type, p_brand, count(*) AS n,
  count(*) FILTER (regexp_matches(p_name, 'red|blue')) AS heritage FROM part GROUP BY ALL""")
def ag20(spark, folder):
    part = table(spark, folder, "part")
    marked = an.heritage_filter(part, "p_name", "red|blue").groupBy("p_type", "p_brand").agg(
        F.count("*").alias("heritage"))
    return (an.zone_counts(part, "p_type", "p_brand").join(marked, ["p_type", "p_brand"], "left")
            .withColumn("heritage", F.coalesce("heritage", F.lit(0))))


@query("ag21_watch_topics", """SELECT o_orderpriority, count(*) FILTER (d >= lim) AS items_recent,
  count(DISTINCT CASE WHEN d >= lim THEN d END) AS meetings_recent, strftime(max(d), '%Y-%m-%d') AS last
 FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d,
   (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 360 AS lim FROM orders) GROUP BY 1""")
def ag21(spark, folder):
    return an.watch_topics(orders(spark, folder).select("o_orderpriority", "o_orderdate"),
                           "o_orderpriority", "o_orderdate")


@query("ag24_trial_report", """WITH r AS (SELECT event_type, user_id % 3 AS lang, value > 10 AS numbers_ok,
   value < 60 AS lang_ok, value, event_id % 1000 AS tok FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY event_type, lang ORDER BY value) - 1 AS i,
   count(*) OVER (PARTITION BY event_type, lang) AS c FROM r)
 SELECT event_type, lang, count(*) AS n, count(*) FILTER (numbers_ok) AS numbers_ok,
  count(*) FILTER (lang_ok) AS lang_ok, count(*) FILTER (numbers_ok AND lang_ok) AS all_ok, max(CASE WHEN i = c // 2 THEN value END) AS median_seconds,
  CAST(sum(tok) AS BIGINT) AS tokens FROM o GROUP BY ALL""")
def ag24(spark, folder):
    r = events(spark, folder).select(
        "event_type", (F.col("user_id") % 3).alias("lang"), (F.col("value") > 10).alias("numbers_ok"),
        (F.col("value") < 60).alias("lang_ok"), "value", (F.col("event_id") % 1000).alias("tok"))
    return an.trial_report(r, ["event_type", "lang"], ["numbers_ok", "lang_ok"], "value", "tok")


@query("ag25_cost_estimate", """SELECT lang, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(floor(sum(length(text)) / 3.2) AS BIGINT) AS tokens,
  round(floor(sum(length(text)) / 3.2) * 0.15 / 1000000, 6) AS usd_in,
  round(floor(sum(length(text)) / 3.2) * 0.6 / 1000000, 6) AS usd_out FROM documents GROUP BY lang""")
def ag25(spark, folder):
    return an.cost_estimate(table(spark, folder, "documents"), "text", 0.15, 0.6, "lang")


GROUPS = [("rules", ["1-URGENT", "2-HIGH"]), ("works", ["2-HIGH", "3-MEDIUM", "O"]), ("other", ["F"])]


@query("ag26_group_decisions", """SELECT 'rules' AS "group", o_orderkey FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
 UNION ALL SELECT 'works', o_orderkey FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM') OR o_orderstatus = 'O'
 UNION ALL SELECT 'other', o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def ag26(spark, folder):
    return an.group_decisions(orders(spark, folder), F.array("o_orderpriority", "o_orderstatus"),
                              GROUPS).select("group", "o_orderkey")


@query("ag27_distinct_counts", """SELECT l_returnflag, count(*) AS items, count(DISTINCT l_partkey) AS candidates,
  count(*) FILTER (l_linestatus = 'O') AS held_back, count(DISTINCT l_orderkey) AS meetings
 FROM lineitem GROUP BY 1""")
def ag27(spark, folder):
    return st.distinct_counts(table(spark, folder, "lineitem"), "l_returnflag", "l_partkey",
                              F.col("l_linestatus") == "O", "l_orderkey")


# ---- top-k, order, sets -------------------------------------------------------------------------------

@query("tk1_latest_meetings", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders
 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def tk1(spark, folder):
    return st.latest(orders(spark, folder), "o_orderdate", 10, "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query("tk2_top_amounts", """SELECT l_orderkey, l_extendedprice, l_partkey, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 3""")
def tk2(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey")
    return an.top_k(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"),
                                         F.col("l_suppkey")], 3).select(
        "l_orderkey", "l_extendedprice", "l_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("tk3_order_threads", """SELECT o_custkey, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first
 FROM orders GROUP BY 1""")
def tk3(spark, folder):
    g = orders(spark, folder).groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"))
    return st.ordered_by_size(g, "n", "first", "o_custkey")


@query("so1_union_current_archive", """SELECT 'customer' AS source, c_custkey AS id, c_name AS name,
  c_mktsegment AS segment, c_acctbal AS bal FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def so1(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("bal"))
    return st.union_sources({"customer": c, "supplier": s})


@query("so2_union_search_rows", """SELECT 'item' AS kind, CAST(doc_id AS VARCHAR) AS ref, lang, length(text) AS n FROM documents
 UNION ALL SELECT 'summary', conv_id || '-' || turn, 'fr', length(text) FROM conversations""")
def so2(spark, folder):
    from recordlake.operators.search import search_rows
    rows = search_rows(table(spark, folder, "documents"), table(spark, folder, "conversations"))
    return rows.select("kind", "ref", "lang", F.length("body").cast("bigint").alias("n"))


@query("so3_except_known", """SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 40
 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity <= 5""")
def so3(spark, folder):
    li = table(spark, folder, "lineitem").select("l_partkey", "l_quantity")
    return st.except_known(li.where("l_quantity >= 40"), li.where("l_quantity <= 5"), "l_partkey")


@query("so4_distinct_keep_order", r"""WITH w AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (
   SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS l FROM documents)),
 f AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY ALL)
 SELECT doc_id, count(*) AS n, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def so4(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", st.distinct_keep_order(t.words("text")).alias("w"))
    return d.where(F.size("w") > 0).select("doc_id", F.size("w").cast("bigint").alias("n"),
                                           F.md5(F.array_join("w", " ")).alias("digest"))
