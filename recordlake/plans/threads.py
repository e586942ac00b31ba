"""Queries over linked items (AG11-AG15, SG19, JN1, JN2, GR1-GR3, DG1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.operators import linking as lk
from recordlake.plans.catalog import query, table


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


SQL_KEY = ("list_aggregate(list_filter(regexp_extract_all(strip_accents(lower(title)), "
           f"'[a-z]{{2,}}'), lambda w: w NOT IN ({_quoted(lx.TITLE_ARTICLES)})), 'string_agg', ' ')")

SQL_ITEMS = rf"""all_items AS (
  SELECT d.doc_id AS item_id, CAST(regexp_extract(source, '(\d+)$', 1) AS INT) AS grp,
    string_split(text, chr(10))[1] AS title,
    CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS text,
    coalesce(l.toxic, 0) = 1 AS sensitive, coalesce(l.quality, 1) = 0 AS deferred
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
keyed AS (SELECT *, coalesce({SQL_KEY}, '') AS tkey FROM all_items),
kinds AS (SELECT *, CASE WHEN sensitive THEN 'sensitive'
   WHEN regexp_matches(tkey, '{lx.STANDING_TITLE}') THEN 'routine'
   WHEN text = '' OR length(regexp_replace(text, '[^0-9]', '', 'g')) > 0.12 * length(text)
     OR (regexp_matches(tkey, '{lx.TABLE_TITLE}') AND length(text) < 600) THEN 'table'
   ELSE 'linkable' END AS kind FROM keyed),
items AS (SELECT * FROM kinds WHERE kind = 'linkable')"""

SQL_TERMS = rf"""{SQL_ITEMS},
word AS (SELECT item_id, unnest(regexp_extract_all(
    strip_accents(lower(title || ' ' || title || ' ' || text)), '[a-z]{{4,}}')) AS w FROM items),
acr AS (SELECT item_id, grp, a, contains(' ' || array_to_string(ta, ' ') || ' ', ' ' || a || ' ') AS in_title FROM (
  SELECT item_id, grp, unnest(list_filter(regexp_extract_all(text || ' ' || title, '[\p{{L}}\p{{N}}_]+'),
     lambda x: regexp_full_match(x, '[A-Z]{{3,6}}'))) AS a,
   list_filter(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+'),
     lambda x: regexp_full_match(x, '[A-Z]{{3,6}}')) AS ta FROM items)
  WHERE a NOT IN ({_quoted(lx.NOT_ACRONYMS)}) AND lower(a) NOT IN ({_quoted(lx.CIVIC_TERMS)})),
acr_n AS (SELECT item_id, grp, lower(a) AS acronym, count(*) AS n, bool_or(in_title) AS in_title
  FROM acr GROUP BY ALL),
tok AS (SELECT item_id, t AS term, 1 AS k FROM (SELECT item_id,
    CASE WHEN length(w) > 5 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS t FROM word)
   WHERE t NOT IN ({_quoted(lx.STOP_TERMS + lx.CIVIC_TERMS)})
  UNION ALL SELECT item_id, acronym, 3 * n FROM acr_n),
tf AS (SELECT item_id, term, CAST(sum(k) AS BIGINT) AS tf FROM tok GROUP BY ALL)"""

SQL_VECTORS = rf"""{SQL_TERMS},
n_items AS (SELECT count(*) AS n FROM items),
freq AS (SELECT term, count(*) AS df, ln((max(n) + 1.0) / (count(*) + 0.5)) AS idf
  FROM tf, n_items GROUP BY term),
vec AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight
  FROM (SELECT item_id, tf.term, (1 + ln(tf)) * idf AS x FROM tf JOIN freq ON tf.term = freq.term))"""

SQL_CLASSES = rf"""{SQL_VECTORS},
sig AS (SELECT i.item_id, i.grp, coalesce(s1, '') || '|' || coalesce(s2, '') AS sig, s1 IS NOT NULL AS has
  FROM items i LEFT JOIN (SELECT item_id, md5(string_agg(term || ':' || tf, ',' ORDER BY term)) AS s1
      FROM tf GROUP BY 1) x ON i.item_id = x.item_id
    LEFT JOIN (SELECT item_id, string_agg(acronym || n || in_title, ',' ORDER BY acronym) AS s2
      FROM acr_n GROUP BY 1) y ON i.item_id = y.item_id),
cls AS (SELECT sig, min(item_id) AS rep, min(grp) AS g1, max(grp) AS g2 FROM sig WHERE has GROUP BY sig),
cv AS (SELECT rep, g1, g2, term, weight FROM vec JOIN cls ON vec.item_id = cls.rep),
cos AS (SELECT a.rep AS a, b.rep AS b, sum(a.weight * b.weight) AS c FROM cv a JOIN cv b
  ON a.term = b.term AND a.rep < b.rep
  WHERE NOT (a.g1 = a.g2 AND b.g1 = b.g2 AND a.g1 = b.g1) GROUP BY ALL HAVING c >= 0.3)"""


def items_of(spark, folder):
    return lk.as_items(table(spark, folder, "documents"), table(spark, folder, "labels"))


def linkable(spark, folder):
    return lk.split_standing(items_of(spark, folder)).where("kind = 'linkable'").drop("kind")


@query("gr3_split_standing", f"""WITH {SQL_ITEMS} SELECT kind, count(*) AS items,
  count(DISTINCT grp) AS meetings FROM kinds GROUP BY kind""")
def gr3(spark, folder):
    return lk.split_standing(items_of(spark, folder)).groupBy("kind").agg(
        F.count("*").alias("items"), F.count_distinct("grp").alias("meetings"))


SQL_NAMES = rf"""{SQL_TERMS},
name AS (SELECT unnest(regexp_extract_all(text, '\p{{Lu}}\p{{L}}+')) AS n FROM benchmark),
name_term AS (SELECT CASE WHEN length(w) > 5 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS term
   FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(n)), '[a-z]{{4,}}')) AS w FROM name)
  UNION SELECT lower(n) FROM name WHERE regexp_full_match(upper(n), '[A-Z]{{3,6}}'))"""


def people(spark, folder):
    """Names to leave out: the capitalised words of the benchmark passages."""
    words = F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}+)"), 1)
    return table(spark, folder, "benchmark").select(F.explode(words).alias("name"))


@query("sg19_count_acronyms", f"WITH {SQL_NAMES} SELECT item_id, acronym, n, in_title FROM acr_n WHERE acronym NOT IN (SELECT term FROM name_term)")
def sg19(spark, folder):
    return lk.count_acronyms(linkable(spark, folder), people(spark, folder)).drop("grp")


@query("ag12_term_counts", f"WITH {SQL_NAMES} SELECT item_id, term, tf FROM tf WHERE term NOT IN (SELECT term FROM name_term)")
def ag12(spark, folder):
    return lk.term_counts(linkable(spark, folder), people(spark, folder))


@query("ag11_document_frequency",
       f"WITH {SQL_VECTORS} SELECT term, df, round(idf, 9) AS idf FROM freq")
def ag11(spark, folder):
    items = linkable(spark, folder)
    return lk.document_frequency(lk.term_counts(items), items.count()).select(
        "term", "df", F.round("idf", 9).alias("idf"))


@query("ag13_unit_vectors",
       f"WITH {SQL_VECTORS} SELECT item_id, term, round(weight, 9) AS weight FROM vec")
def ag13(spark, folder):
    items = linkable(spark, folder)
    counts = lk.term_counts(items)
    return lk.unit_vectors(counts, lk.document_frequency(counts, items.count())).select(
        "item_id", "term", F.round("weight", 9).alias("weight"))


def _classes(spark, folder):
    prof = lk.cut_lineage(lk.profiles(linkable(spark, folder)))
    cls = lk.cut_lineage(lk.classes(prof))
    return lk.class_rows(prof, cls, cls.agg(F.sum("copies")).first()[0] or 0)


@query("jn1_similar_pairs", f"WITH {SQL_CLASSES} SELECT a, b, round(c, 6) AS cosine FROM cos")
def jn1(spark, folder):
    return lk.similar_rows(_classes(spark, folder)).select("a", "b", F.round("cosine", 6).alias("cosine"))


SQL_ACR_PAIRS = """rare AS (SELECT acronym FROM acr_n GROUP BY 1 HAVING count(*) <= 12),
acr_pairs AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM acr_n a JOIN acr_n b
  ON a.acronym = b.acronym AND a.item_id < b.item_id AND a.grp <> b.grp
  WHERE a.acronym IN (SELECT acronym FROM rare) AND a.n >= 2 AND b.n >= 2
    AND (a.in_title OR b.in_title))"""


@query("jn2_acronym_pairs", f"WITH {SQL_TERMS}, {SQL_ACR_PAIRS} SELECT a, b FROM acr_pairs")
def jn2(spark, folder):
    return lk.acronym_pairs(lk.count_acronyms(linkable(spark, folder)))


SQL_RECURSIVE = """link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(node, label) AS (
  SELECT a, a FROM link UNION SELECT b, b FROM link
  UNION
  SELECT l.b, r.label FROM reach r JOIN link l ON r.node = l.a WHERE r.label < l.b),
comp AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"""


# Components of documents that share a first line (a bounded number of lines per document).
@query("gr1_connected_components", f"""WITH RECURSIVE e0 AS (
  SELECT doc_id, unnest(list_distinct(list_filter(string_split(text, chr(10)),
    lambda s: length(s) >= 20))) AS line FROM documents),
edge AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY line) AS a, doc_id AS b FROM e0
  QUALIFY a <> b), {SQL_RECURSIVE} SELECT node, component FROM comp""")
def gr1(spark, folder):
    docs = table(spark, folder, "documents")
    line = docs.select("doc_id", F.explode(F.array_distinct(F.filter(
        F.split("text", "\n"), lambda s: F.length(s) >= 20))).alias("line"))
    first = line.groupBy("line").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    edges = line.join(first, "line").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()
    return lk.components(edges)


SQL_THREADS = f"""{SQL_CLASSES}, {SQL_ACR_PAIRS},
member AS (SELECT s.item_id, c.rep FROM sig s LEFT JOIN cls c ON s.sig = c.sig),
pair AS (
  SELECT a, b FROM acr_pairs
  UNION SELECT x.item_id, y.item_id FROM cos JOIN sig x ON x.sig = (SELECT sig FROM cls WHERE rep = cos.a)
     JOIN sig y ON y.sig = (SELECT sig FROM cls WHERE rep = cos.b) WHERE x.grp <> y.grp
  UNION SELECT x.item_id, y.item_id FROM sig x JOIN sig y ON x.sig = y.sig AND x.has
     AND x.item_id <> y.item_id AND x.grp <> y.grp),
edge AS (SELECT a, b FROM pair), {SQL_RECURSIVE},
thread AS (SELECT i.*, coalesce(c.component, i.item_id) AS thread FROM items i
  LEFT JOIN comp c ON i.item_id = c.node)"""

SQL_MEETINGS = r"meetings AS (SELECT DISTINCT grp FROM all_items)"


@query("ag14_label_terms", f"""WITH RECURSIVE {SQL_THREADS},
w AS (SELECT thread, term, round(sum(weight), 9) AS w FROM thread t JOIN vec v ON t.item_id = v.item_id
  GROUP BY ALL)
SELECT thread, string_agg(term, ' ' ORDER BY w DESC, term) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY thread ORDER BY w DESC, term) AS r FROM w)
WHERE r <= 4 GROUP BY thread""")
def ag14(spark, folder):
    members, vectors = lk.issue_threads(items_of(spark, folder))
    ids = canonical(members)
    return lk.label_terms(ids, vectors)


def canonical(members):
    """Threads named by their smallest item."""
    low = members.groupBy("thread").agg(F.min("item_id").alias("low"))
    return members.join(low, "thread").drop("thread").withColumnRenamed("low", "thread")


@query("ag15_thread_summary", f"""WITH RECURSIVE {SQL_THREADS}, {SQL_MEETINGS},
s AS (SELECT thread, min_by(title, CAST(grp AS BIGINT) * 1000000000 + item_id) AS title, count(*) AS n_items,
  count(DISTINCT grp) AS n_meetings, min(grp) AS first, max(grp) AS last,
  max_by(deferred, CAST(grp AS BIGINT) * 1000000000 + item_id) AS stalled FROM thread GROUP BY thread),
l AS (SELECT *, (SELECT count(*) FROM meetings m WHERE m.grp > s.last) AS later_meetings FROM s)
SELECT thread, title, n_items, n_meetings, first, last, later_meetings,
  CASE WHEN n_meetings >= 3 THEN 'recurring' WHEN n_meetings = 2 THEN 'returned' ELSE 'one-off' END
    AS status, stalled AND later_meetings >= 2 AS possibly_dropped FROM l""")
def ag15(spark, folder):
    items = items_of(spark, folder)
    members, _ = lk.issue_threads(items, terms=False)
    return lk.thread_summary(canonical(members), items.select("grp").distinct()).drop("stalled")


@query("gr2_issue_threads", f"""WITH RECURSIVE {SQL_THREADS}
 SELECT item_id, grp, thread FROM thread""")
def gr2(spark, folder):
    members, _ = lk.issue_threads(items_of(spark, folder), terms=False)
    return canonical(members).select("item_id", "grp", "thread")


def flagship(spark, folder):
    """Threads with their summary and label: which matters come back, and which were dropped?"""
    items = items_of(spark, folder)
    members, vectors = lk.issue_threads(items)
    members = lk.cut_lineage(canonical(members))
    summary = lk.thread_summary(members, items.select("grp").distinct()).drop("stalled")
    return summary.join(lk.label_terms(members, vectors), "thread", "left")
