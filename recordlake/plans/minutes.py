"""Signal queries (SG*, AG4-AG8, PV14, DG2): French minutes derived row by row from lineitem.

Every line of ``lineitem`` is turned into the text of one agenda item (amount, vote, reference,
follow-up, place, date ...), so the extractors read text that grows with the table.  The SQL on the
other side never reads that text: it states what the numbers of the row imply.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.operators import analytics as an
from recordlake.operators import signals as sg
from recordlake.plans.catalog import query, table
from recordlake.session import spread

MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre",
          "octobre", "novembre", "décembre"]
MONTH_CASE = "CASE l_suppkey % 12 " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS)) + " END"

# The text of an item, in SQL that Spark runs over the whole table.
ITEM_SQL = f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, l_orderkey,
 to_date(l_shipdate) AS date,
 CASE l_linenumber WHEN 1 THEN 'Budget primitif de la voirie' WHEN 2 THEN 'Travaux de toiture'
   WHEN 3 THEN 'Droit de préemption urbain' ELSE 'Questions sur l’école' END AS title,
 concat_ws(' ',
 concat('Le conseil étudie un montant de ',
   CASE WHEN euros >= 1000 THEN concat(cast(euros div 1000 AS string), ' ',
          lpad(cast(euros % 1000 AS string), 3, '0')) ELSE cast(euros AS string) END, ',',
   lpad(cast(cents % 100 AS string), 2, '0'), ' € pour M. le Maire.'),
 concat('Le taux retenu est de ', cast(cast(round(l_tax * 100) AS int) AS string), ',5 % cette fois.'),
 CASE l_suppkey % 5 WHEN 0 THEN 'Vote du conseil à l’unanimité.'
   WHEN 1 THEN concat('Vote : ', cast(cast(l_quantity AS int) AS string),
                      ' voix pour, 2 contre, deux abstentions.')
   WHEN 2 THEN 'La proposition est rejetée à la majorité des voix.'
   WHEN 3 THEN concat('Adopté par ', cast(cast(l_quantity AS int) AS string),
                      ' voix pour et une abstention.') ELSE 'Rien de plus.' END,
 CASE l_partkey % 6
   WHEN 0 THEN concat('Vu l’article L2121-', cast(l_linenumber AS string),
                      ' du code général des collectivités territoriales.')
   WHEN 1 THEN concat('Vu le décret n° 2022-', cast(l_suppkey AS string), ' applicable.')
   WHEN 2 THEN concat('Selon la loi 2023-', cast(l_suppkey AS string), ' en vigueur.')
   WHEN 3 THEN 'Le budget suit l’instruction M57 du trésor.'
   WHEN 4 THEN 'Ces travaux sont menés conformément aux usages locaux.'
   ELSE 'Aucune remarque.' END,
 CASE l_linenumber % 4 WHEN 0 THEN 'À titre exceptionnel, une dérogation est accordée.'
   WHEN 1 THEN 'Les charges exceptionnelles sont inscrites.' ELSE 'Pas de remarque.' END,
 CASE l_suppkey % 7 WHEN 0 THEN 'Le conseil autorise le Maire à signer.'
   WHEN 1 THEN 'Le dossier est reporté.' WHEN 2 THEN 'Les travaux seront réalisés au printemps.'
   WHEN 3 THEN 'Le résultat reporté est affecté.' ELSE 'Fin du point.' END,
 concat('La fête aura lieu le ', cast(1 + l_partkey % 31 AS string), ' ', {MONTH_CASE}, '.'),
 CASE l_partkey % 3 WHEN 0 THEN concat('Les travaux au ', cast(1 + l_suppkey % 900 AS string),
        ' rue des Tilleuls et autour avancent.')
   WHEN 1 THEN 'Le lieu-dit Fontbelle est concerné.'
   ELSE 'La route de Riols 11999 est ailleurs.' END) AS text
FROM (SELECT *, cast(round(l_extendedprice * 100) AS bigint) AS cents,
             cast(round(l_extendedprice * 100) AS bigint) div 100 AS euros FROM {{lineitem}})
"""

LI_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id"


def items(spark, folder):
    return spark.sql(ITEM_SQL, lineitem=spread(table(spark, folder, "lineitem")))


def split(spark, folder):
    return sg.with_sentences(items(spark, folder))


@query("sg1_votes", f"""SELECT {LI_ID}, CASE l_suppkey % 5 WHEN 0 THEN 'unanimous' WHEN 2 THEN 'rejected'
   ELSE 'majority' END AS kind,
  CASE WHEN l_suppkey % 5 IN (1, 3) THEN CAST(l_quantity AS INT) END AS votes_for,
  CASE WHEN l_suppkey % 5 = 1 THEN 2 END AS against,
  CASE l_suppkey % 5 WHEN 1 THEN 2 WHEN 3 THEN 1 END AS abstentions
  FROM lineitem WHERE l_suppkey % 5 <> 4""")
def sg1(spark, folder):
    return sg.long(split(spark, folder), "item_id", sg.votes(F.col("sentences"))).select(
        "item_id", "kind", F.col("for").alias("votes_for"), "against", "abstentions")


@query("sg4_amounts", f"""SELECT {LI_ID}, 'eur' AS kind, round(l_extendedprice, 2) AS value FROM lineitem
 UNION ALL SELECT {LI_ID}, 'pct', CAST(round(l_tax * 100) AS INT) + 0.5 FROM lineitem""")
def sg4(spark, folder):
    return sg.long(split(spark, folder), "item_id", sg.amounts(F.col("sentences"))).select(
        "item_id", "kind", "value")


@query("sg5_legal_refs", f"""SELECT {LI_ID}, CASE l_partkey % 6
  WHEN 0 THEN 'CGCT L2121-' || l_linenumber WHEN 1 THEN 'décret 2022-' || l_suppkey
  WHEN 2 THEN 'loi 2023-' || l_suppkey ELSE 'instruction M57' END AS key
 FROM lineitem WHERE l_partkey % 6 <= 3""")
def sg5(spark, folder):
    return sg.long(split(spark, folder), "item_id", sg.legal_refs(F.col("sentences"))).select(
        "item_id", "key")


@query("sg6_exceptions", f"""SELECT {LI_ID}, unnest(['exceptionnel', 'dérogation']) AS marker
 FROM lineitem WHERE l_linenumber % 4 = 0""")
def sg6(spark, folder):
    found = sg.long(split(spark, folder), "item_id", sg.exceptions(F.col("sentences")))
    return found.select("item_id", F.regexp_replace("marker", "^à titre ", "").alias("marker"))


@query("sg7_rule_mentions", f"""SELECT {LI_ID}, 'Ces travaux sont menés conformément aux usages locaux.'
 AS sentence FROM lineitem WHERE l_partkey % 6 = 4""")
def sg7(spark, folder):
    return sg.long(split(spark, folder), "item_id", sg.rule_mentions(F.col("sentences"))).select(
        "item_id", "sentence")


@query("sg8_followups", f"""SELECT {LI_ID}, CASE l_suppkey % 7 WHEN 0 THEN 'authorisation'
  WHEN 1 THEN 'deferred' ELSE 'planned' END AS type FROM lineitem WHERE l_suppkey % 7 IN (0, 1, 2)""")
def sg8(spark, folder):
    return sg.long(split(spark, folder), "item_id", sg.followups(F.col("sentences"))).select(
        "item_id", "type")


TOPIC_COUNTS = """
 CASE l_linenumber WHEN 1 THEN 3 ELSE 0 END + CASE l_partkey % 6 WHEN 3 THEN 1 ELSE 0 END AS finances,
 CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 0 END + CASE l_partkey % 6 WHEN 4 THEN 1 ELSE 0 END
   + CASE l_suppkey % 7 WHEN 2 THEN 1 ELSE 0 END
   + CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS works,
 CASE WHEN l_linenumber = 3 THEN 3 ELSE 0 END AS presale,
 CASE WHEN l_linenumber >= 4 THEN 3 ELSE 0 END AS school, 1 AS local"""


@query("sg9_rank_topics", f"""WITH c AS (SELECT {LI_ID}, {TOPIC_COUNTS} FROM lineitem),
 u AS (UNPIVOT c ON finances, works, presale, school, local INTO NAME k VALUE hits)
 SELECT item_id, CASE k WHEN 'finances' THEN 'finances' WHEN 'works' THEN 'voirie et travaux'
  WHEN 'presale' THEN 'droit de préemption' WHEN 'school' THEN 'école et enfance'
  ELSE 'associations et vie locale' END AS topic, CAST(hits AS INT) AS hits FROM u WHERE hits > 0""")
def sg9(spark, folder):
    ranked = sg.long(items(spark, folder), "item_id", sg.topic_hits("title", "text"))
    return ranked.select("item_id", "topic", "hits")


@query("sg10_flag_sensitive", f"SELECT {LI_ID}, l_linenumber = 3 AS sensitive FROM lineitem")
def sg10(spark, folder):
    return items(spark, folder).select("item_id", sg.is_sensitive("title", "text").alias("sensitive"))


@query("sg11_places", f"""SELECT {LI_ID}, CASE l_partkey % 3 WHEN 0 THEN 'street' ELSE 'lieu-dit' END AS kind,
 CASE l_partkey % 3 WHEN 0 THEN 'rue des Tilleuls' ELSE 'Fontbelle' END AS label,
 CASE l_partkey % 3 WHEN 0 THEN CAST(1 + l_suppkey % 900 AS VARCHAR) END AS number
 FROM lineitem WHERE l_partkey % 3 <> 2""")
def sg11(spark, folder):
    return sg.long(items(spark, folder), "item_id", sg.places("text")).select("item_id", "kind", "label", "number")


@query("sg12_parcels", """SELECT l_orderkey, chr(65 + CAST(l_suppkey % 26 AS INT)) || 'B' AS section,
  lpad(CAST(1 + l_partkey % 900 AS VARCHAR), 4, '0') AS number,
  CASE l_linenumber % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'table' ELSE 'bare' END AS form
 FROM lineitem""")
def sg12(spark, folder):
    li = table(spark, folder, "lineitem")
    section = F.concat(F.char((65 + F.col("l_suppkey") % 26).cast("int")), F.lit("B"))
    number = (1 + F.col("l_partkey") % 900).cast("string")
    text = (F.when(F.col("l_linenumber") % 3 == 0, F.concat(
                F.lit("Le bien cadastré section "), section, F.lit(" n° "), number, F.lit(" est libre.")))
            .when(F.col("l_linenumber") % 3 == 1, F.concat(
                F.lit("Plan du cadastre\n| "), section, F.lit(" | "), number, F.lit(" | prairie |")))
            .otherwise(F.concat(F.lit("Le cadastre porte "), section, F.lit(" 0"),
                                F.lpad(number, 3, "0"), F.lit(" ici."))))
    pages = li.select("l_orderkey", text.alias("text"))
    return sg.long(pages, "l_orderkey", sg.parcels("text", F.lit(False))).select(
        "l_orderkey", "section", "number", "form")


@query("sg13_dates", f"""SELECT {LI_ID}, strftime(d, '%Y-%m-%d') AS mentioned FROM (SELECT *,
  TRY_CAST(year(l_shipdate) || '-' || lpad(CAST(1 + l_suppkey % 12 AS VARCHAR), 2, '0') || '-'
    || lpad(CAST(1 + l_partkey % 31 AS VARCHAR), 2, '0') AS DATE) AS d FROM lineitem)
 WHERE d >= CAST(l_shipdate AS DATE) AND d <= CAST(l_shipdate AS DATE) + 400""")
def sg13(spark, folder):
    found = sg.long(split(spark, folder), "item_id",
                    sg.mentioned_dates(F.col("sentences"), F.col("date")))
    return found.select("item_id", F.date_format("mentioned", "yyyy-MM-dd").alias("mentioned"))


@query("sg14_date_documents", r"""SELECT o_orderkey,
  CASE WHEN year(o_orderdate) >= 2000 OR o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value,
  CASE WHEN year(o_orderdate) >= 2000 THEN CASE o_orderkey % 2 WHEN 0 THEN 'long' ELSE 'header' END
   WHEN o_orderkey % 3 = 0 THEN 'filename' END AS source,
  CASE WHEN year(o_orderdate) >= 2000 OR o_orderkey % 3 = 0 THEN 'tentative' ELSE 'missing' END AS status FROM orders""")
def sg14(spark, folder):
    orders = table(spark, folder, "orders")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(
        " ", F.lit("Séance du"), F.dayofmonth("o_orderdate").cast("string"), month,
        F.year("o_orderdate").cast("string"))).otherwise(
        F.concat(F.lit("CONSEIL MUNICIPAL DU "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    file = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("CR"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".pdf")))
    # Dates in texts are read for years from 2000 on; of earlier years only the file names tell.
    pages = orders.select("o_orderkey", text.alias("text"), file.alias("file"))
    return sg.date_documents(pages, "text", "file").select("o_orderkey", "value", "source", "status")


# ---- people: names derived from the customers -----------------------------------------------------

FIRST = ["Alba", "Bruno", "Carla", "Denis", "Elsa", "Fabien", "Gina", "Hugo"]
FIRST_CASE = "CASE {0} % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIRST)) + " END"


def sql_name(key: str) -> str:
    return (f"({FIRST_CASE.format(key)} || ' V' || "
            f"translate(CAST({key} AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || 'OR')")


def person(key):
    first = F.element_at(F.array(*[F.lit(f) for f in FIRST]), (F.col(key) % 8 + 1).cast("int"))
    return F.concat(first, F.lit(" V"), F.translate(F.col(key).cast("string"), "0123456789",
                                                    "ABCDEFGHIJ"), F.lit("OR"))


def people_pages(spark, folder):
    c = (table(spark, folder, "customer").select("c_custkey", "c_nationkey")
         .withColumn("other", F.col("c_custkey") + 1).withColumn("third", F.col("c_custkey") + 2))
    text = F.concat(
        F.lit("Etaient présents : "), person("c_custkey"), F.lit(", "), person("other"),
        F.lit(". Etaient absents : "), person("third"), F.lit(" procuration à "), person("other"),
        F.lit(". La séance est ouverte sous la présidence de Monsieur "), person("c_custkey"),
        F.lit(", Maire.\nVendeur : "), person("third"), F.lit(", SCI Les Pins et\n"), person("other"),
        F.lit("\nFin de page."))
    return c.select("c_custkey", text.alias("text"))


@query("sg16_chairs", f"""SELECT c_custkey, 'V' || lower(translate(CAST(c_custkey AS VARCHAR),
 '0123456789', 'ABCDEFGHIJ')) || 'or' AS chair FROM customer""")
def sg16(spark, folder):
    return people_pages(spark, folder).select("c_custkey", sg.chair("text").alias("chair"))


@query("sg17_attendance", f"""WITH c AS (SELECT c_custkey, c_custkey + 1 AS o, c_custkey + 2 AS t FROM customer)
 SELECT c_custkey, 'present' AS role, {sql_name('c_custkey')} AS name FROM c
 UNION ALL SELECT c_custkey, 'present', {sql_name('o')} FROM c
 UNION ALL SELECT c_custkey, 'absent', {sql_name('t')} FROM c
 UNION ALL SELECT c_custkey, 'holder', {sql_name('o')} FROM c""")
def sg17(spark, folder):
    return sg.long(people_pages(spark, folder), "c_custkey", sg.attendance("text")).drop("seq")


@query("sg18_names", f"""WITH c AS (SELECT c_custkey, c_custkey + 1 AS o, c_custkey + 2 AS t FROM customer)
 SELECT c_custkey, 'Vendeur' AS field, {sql_name('t')} AS name FROM c
 UNION ALL SELECT c_custkey, 'Vendeur', {sql_name('o')} FROM c
 UNION ALL SELECT c_custkey, 'honorific', {sql_name('c_custkey')} FROM c""")
def sg18(spark, folder):
    pages = people_pages(spark, folder)
    titled = pages.select("c_custkey", F.lit("honorific").alias("field"),
                          F.explode(sg.honorific_names("text")).alias("name"))
    return sg.long(pages, "c_custkey", sg.private_names("text")).drop("seq").unionByName(titled)


# ---- language ----------------------------------------------------------------------------------------

LANGS = {**{k: lx.STOP_WORDS[k] for k in ("fr", "en")}, **lx.EXTRA_STOP_WORDS}


def _sql_hits(words):
    return ("len(list_filter(w, lambda x: x IN ("
            + ", ".join(f"'{x}'" for x in words) + ")))")


@query("sg21_detect_language", f"""WITH d AS (SELECT doc_id, lower(text) AS low FROM documents),
 w AS (SELECT doc_id, regexp_extract_all(low, '[a-zà-ÿ’'']+') AS w,
   regexp_extract_all(low, '\\p{{L}}+') AS lw FROM d),
 r AS (SELECT doc_id, len(w) AS n, {', '.join(f'{_sql_hits(ws)} AS h_{k}' for k, ws in LANGS.items())},
   len(list_filter(lw, lambda x: x IN ({', '.join(f"'{x}'" for x in lx.FRENCH_FUNCTION_WORDS)}))) AS fr,
   len(list_filter(lw, lambda x: x IN ({', '.join(f"'{x}'" for x in lx.OTHER_FUNCTION_WORDS)}))) AS oth,
   len(lw) AS ln FROM w)
 SELECT doc_id, CASE WHEN greatest(h_fr, h_en, h_de, h_es) = 0 THEN NULL
   WHEN h_de = greatest(h_fr, h_en, h_de, h_es) THEN 'de' WHEN h_en = greatest(h_fr, h_en, h_es) THEN 'en'
   WHEN h_es = greatest(h_fr, h_es) THEN 'es' ELSE 'fr' END AS lang,
  round(CASE WHEN n = 0 THEN 0.0 ELSE greatest(h_fr, h_en, h_de, h_es) / n END, 6) AS ratio,
  ln >= 3 AND ((fr >= 2 AND fr > 2 * oth) OR (fr >= 1 AND oth = 0)) AS french FROM r""")
def sg21(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return d.select("doc_id", sg.language("text", LANGS).alias("best"),
                    sg.is_french("text").alias("french")).select(
        "doc_id", F.col("best.lang").alias("lang"), F.round("best.ratio", 6).alias("ratio"), "french")


# ---- finance over the items -------------------------------------------------------------------------

def signalled(spark, folder):
    """Items with the signal columns the finance reports read."""
    s = F.col("sentences")
    return (split(spark, folder)
            .withColumns({"sensitive": sg.is_sensitive("title", "text"),
                          "amounts": sg.amounts(s), "refs": sg.legal_refs(s),
                          "wording": sg.rule_mentions(s), "exceptions": sg.exceptions(s),
                          "followups": sg.followups(s), "votes": sg.votes(s)})
            .drop("sentences", "text"))


@query("ag4_finance_summary", """SELECT year(l_shipdate) AS year, count(*) AS items,
  count(*) FILTER (l_linenumber <> 3) AS with_money,
  count(*) FILTER (l_linenumber <> 3 AND l_partkey % 6 <= 3) AS cited,
  count(*) FILTER (l_linenumber <> 3 AND l_partkey % 6 = 4) AS worded,
  count(*) FILTER (l_linenumber <> 3 AND l_partkey % 6 = 5) AS silent,
  count(*) FILTER (l_linenumber <> 3 AND l_linenumber % 4 = 0) AS exceptional
 FROM lineitem GROUP BY 1""")
def ag4(spark, folder):
    return an.finance_summary(signalled(spark, folder), F.year("date").cast("bigint").alias("year"))


@query("ag5_basis", f"""SELECT {LI_ID}, CASE l_partkey % 6 WHEN 0 THEN 'cites: CGCT L2121-' || l_linenumber
  WHEN 1 THEN 'cites: décret 2022-' || l_suppkey WHEN 2 THEN 'cites: loi 2023-' || l_suppkey
  WHEN 3 THEN 'cites: instruction M57' WHEN 4 THEN 'rule wording only' ELSE 'none stated' END AS basis
 FROM lineitem WHERE l_linenumber <> 3""")
def ag5(spark, folder):
    return an.money_items(signalled(spark, folder)).select("item_id", an.basis().alias("basis"))


@query("ag7_rules_cited", """SELECT CASE l_partkey % 6 WHEN 0 THEN 'CGCT L2121-' || l_linenumber
  WHEN 1 THEN 'décret 2022-' || l_suppkey WHEN 2 THEN 'loi 2023-' || l_suppkey
  ELSE 'instruction M57' END AS key, count(*) AS items, count(DISTINCT CAST(l_shipdate AS DATE)) AS dates,
  strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last
 FROM lineitem WHERE l_partkey % 6 <= 3 AND l_linenumber <> 3 GROUP BY 1""")
def ag7(spark, folder):
    return an.rules_cited(an.money_items(signalled(spark, folder)))


@query("ag8_exceptions_list", f"""SELECT {LI_ID}, 'à titre exceptionnel' AS marker, 2 AS mentions,
  CASE l_partkey % 6 WHEN 0 THEN 'cites: CGCT L2121-' || l_linenumber
  WHEN 1 THEN 'cites: décret 2022-' || l_suppkey WHEN 2 THEN 'cites: loi 2023-' || l_suppkey
  WHEN 3 THEN 'cites: instruction M57' WHEN 4 THEN 'rule wording only' ELSE 'none stated' END AS basis
 FROM lineitem WHERE l_linenumber % 4 = 0""")
def ag8(spark, folder):
    return an.exceptions_list(signalled(spark, folder)).select("item_id", "marker", "mentions", "basis")


@query("pv14_neighbour_suppression", r"""WITH s AS (SELECT conv_id, turn, text,
   regexp_matches(text, '[0-9]') AS hit FROM conversations),
 f AS (SELECT *, max(hit) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM s)
 SELECT conv_id, turn FROM f WHERE NOT near""")
def pv14(spark, folder):
    from recordlake.operators.privacy import neighbour_suppression
    rows = table(spark, folder, "conversations").withColumn("hit", F.col("text").rlike("[0-9]"))
    return neighbour_suppression(rows, "hit", ["conv_id"], "turn").select("conv_id", "turn")


@query("dg2_archive_digest", """SELECT year(l_shipdate) AS year,
  count(*) FILTER (l_suppkey % 5 <> 4) AS decisions,
  count(*) FILTER (l_suppkey % 5 = 2) AS rejected,
  count(*) FILTER (l_suppkey % 5 = 0) AS unanimous,
  count(*) FILTER (l_suppkey % 5 <> 4 AND CAST(round(l_tax * 100) AS INT) >= 0) AS with_context
 FROM lineitem GROUP BY 1""")
def dg2(spark, folder):
    from recordlake.plans.digests import archive_digest
    d = archive_digest(items(spark, folder).select("item_id", "date", "text"))
    return d.groupBy(F.year("date").cast("bigint").alias("year")).agg(
        F.count("*").alias("decisions"),
        F.count_if(F.col("kind") == "rejected").alias("rejected"),
        F.count_if(F.col("kind") == "unanimous").alias("unanimous"),
        F.count_if(F.col("context") != "").alias("with_context"))
