"""Queries over joins, resolution, versions and search (JN*, DF*, FT*, GR4, AG19, AG22, AG23)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import ids
from recordlake.functions import sequences as sq
from recordlake.functions import text as t
from recordlake.operators import analytics as an
from recordlake.operators import resolve as rs
from recordlake.operators import search as se
from recordlake.operators import versions as vs
from recordlake.plans.catalog import query, table
from recordlake.plans.timelines import sales
from recordlake.session import shared_folder


def li(spark, folder):
    return table(spark, folder, "lineitem")


# ---- sales --------------------------------------------------------------------------------------------

@query("jn3_match_notices", """WITH n AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d,
   o_custkey % 2 AS s, o_custkey % 10000 AS num FROM orders),
 f AS (SELECT l_orderkey, min((l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS r
   FROM lineitem GROUP BY 1),
 s AS (SELECT DISTINCT l.l_orderkey AS id, CAST(f.r[1] AS DATE) AS d, l_suppkey % 2 AS s, l_partkey % 10000 AS num
   FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey)
 SELECT n.s AS side, CAST(n.num AS BIGINT) AS number, count(*) AS matches, count(DISTINCT id) AS sales, strftime(min(s.d), '%Y-%m-%d') AS first_sale
 FROM n JOIN s ON n.s = s.s AND n.num = s.num AND s.d >= n.d - 60 GROUP BY ALL""")
def jn3(spark, folder):
    rows = sales(spark, folder)
    dated = an.sales_by_mutation(rows, "row_no").select("id_mutation", F.col("date").alias("sale_date"))
    parcels = an.sale_parcels(rows).join(dated, "id_mutation")
    side = F.when(F.col("o_custkey") % 2 == 0, "AB").otherwise("C")
    notices = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("date"), side.alias("section"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("number"))
    m = rs.match_notices(notices, parcels, counted=True)
    return m.groupBy(F.when(F.col("section") == "AB", 0).otherwise(1).cast("bigint").alias("side"),
                     F.col("number").cast("bigint").alias("number")).agg(
        F.sum("notices").alias("matches"), F.count_distinct("id_mutation").alias("sales"),
        F.date_format(F.min("sale_date"), "yyyy-MM-dd").alias("first_sale"))


@query("ft5_search_sales", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
   ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
 SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation FROM r GROUP BY l_orderkey
 HAVING max(CASE WHEN n = 1 THEN l_returnflag <> 'R' END)
  AND bool_or(contains('RUE ' || (l_suppkey % 17), 'RUE 7')) AND bool_or(l_suppkey % 2 = 0)""")
def ft5(spark, folder):
    rows = sales(spark, folder)
    return se.search_sales(an.sale_addresses(rows), an.sale_parcels(rows),
                           an.sales_by_mutation(rows, "row_no"), "Rüe 7", "ab").select("id_mutation")


# ---- places: parts as gazetteer -------------------------------------------------------------------------

def gazetteer(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("rank"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, "street").otherwise("municipality").alias("type"),
        F.lit("99001").alias("citycode"), (F.col("p_size") / 50.0).alias("score"),
        (43 + F.col("p_partkey") % 700 / 10000.0).alias("lat"),
        (2 + F.col("p_partkey") % 900 / 10000.0).alias("lon"))


def candidates(spark, folder):
    """Street labels: the words of each part's name and brand type in the order of a label."""
    p = table(spark, folder, "part")
    return p.select(
        F.concat(F.lit("rue du "), F.initcap(F.substring_index("p_name", " ", -1)), F.lit(" "),
                 F.lower("p_brand")).alias("brand_label"),
        F.concat(F.lit("rue des "), F.initcap(F.substring_index("p_name", " ", -1)), F.lit(" "),
                 F.initcap("p_type")).alias("label"),
        F.lit("street").alias("kind"), "p_partkey", "p_size")


SQL_STEM = ("list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(strip_accents(lower({0})), "
            "'[a-z]{{3,}}'), lambda w: w NOT IN ('de','du','des','la','le','les','l','d','en','au','aux','et')), "
            "lambda w: CASE WHEN length(w) > 4 AND regexp_matches(w, '[sx]$') THEN left(w, length(w) - 1) ELSE w END)))")
SQL_PLACES = f"""g AS (SELECT p_partkey AS rank, p_name || ' ' || lower(p_type) AS name FROM part
   WHERE p_size % 2 = 0 AND p_size / 50.0 >= 0.5),
 gt AS (SELECT *, {SQL_STEM.format('name')} AS have FROM g),
 lab AS (SELECT 'rue des ' || upper(left(w, 1)) || substr(w, 2) || ' ' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS label, p_partkey, p_size
   FROM (SELECT *, string_split(p_name, ' ')[-1] AS w FROM part)),
 lt AS (SELECT DISTINCT label, list_filter({SQL_STEM.format('label')}, lambda w: w <> 'rue') AS want FROM lab),
 ok AS (SELECT label, min(rank) AS rank FROM lt JOIN gt ON list_has_all(have, want) AND len(want) > 0 GROUP BY label)"""


@query("jn4_confirm_places", f"""WITH {SQL_PLACES} SELECT label, ok.rank, g.name FROM ok JOIN g ON g.rank = ok.rank""")
def jn4(spark, folder):
    return rs.confirm_places(candidates(spark, folder), gazetteer(spark, folder), "99001").select(
        "label", "rank", "name")


@query("jn5_unconfirmed", f"""WITH {SQL_PLACES} SELECT lower(label) AS key, label, count(*) AS mentions FROM (
  SELECT label FROM lab WHERE label NOT IN (SELECT label FROM ok)
  UNION ALL SELECT 'rue du ' || upper(left(w, 1)) || substr(w, 2) FROM (SELECT string_split(p_name, ' ')[-1] AS w FROM part))
 GROUP BY label""")
def jn5(spark, folder):
    c = candidates(spark, folder)
    both = c.select("label", "kind").unionByName(c.select(F.col("brand_label").alias("label"), "kind"))
    return rs.unconfirmed(both, rs.confirm_places(both, gazetteer(spark, folder), "99001"))


@query("jn7_cache", """WITH c AS (SELECT DISTINCT p_name FROM part WHERE p_retailprice > 950),
 k AS (SELECT DISTINCT p_name FROM part WHERE p_size > 40)
 SELECT p_name, 'kept' AS state FROM c WHERE p_name IN (SELECT p_name FROM k)
 UNION ALL SELECT p_name, 'miss' FROM k WHERE p_name NOT IN (SELECT p_name FROM c)""")
def jn7(spark, folder):
    p = table(spark, folder, "part")
    cache = p.where("p_retailprice > 950").select("p_name").distinct()
    keys = p.where("p_size > 40").select("p_name")
    return rs.prune_cache(cache, keys, "p_name").withColumn("state", F.lit("kept")).unionByName(
        rs.cache_miss(keys, cache, "p_name").withColumn("state", F.lit("miss")))


@query("ag19_place_groups", """WITH p AS (SELECT n_name AS name, c_nationkey % 7 AS k, c_custkey % 400 AS label,
   CAST(o_orderdate AS DATE) AS date, o_orderpriority AS title, o_orderstatus AS topic
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 b AS (SELECT name, k, count(DISTINCT (date, title)) AS items, count(DISTINCT date) AS meetings,
   count(DISTINCT label) AS spellings FROM p GROUP BY ALL),
 t AS (SELECT name, k, topic, count(*) AS n FROM (SELECT DISTINCT name, k, date, title, topic FROM p) GROUP BY ALL),
 m AS (SELECT *, row_number() OVER (PARTITION BY name, k ORDER BY n DESC, topic) AS r FROM t)
 SELECT b.name, b.items, b.meetings, b.spellings, m.topic AS main_theme FROM b JOIN m ON b.name = m.name AND b.k = m.k AND r = 1""")
def ag19(spark, folder):
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"),
                                            F.col("o_custkey") == F.col("c_custkey"))
    p = o.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("name"), (43.31 + (F.col("c_nationkey") % 7) / 1000.0).alias("lat"),
        F.lit(2.22).alias("lon"), (F.col("c_custkey") % 400).alias("label"),
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("topic"))
    return rs.place_groups(p).drop("lat4", "lon4")


def spelled(spark, folder):
    """Names of twelve letters, four customers to a name, one of them with a letter changed."""
    c = table(spark, folder, "customer").select("c_custkey")
    base = F.substring(F.translate(F.md5(F.floor(F.col("c_custkey") / 4).cast("string")),
                                   "0123456789abcdef", "bcdfghjklmnpqrst"), 1, 12)
    typo = F.concat(F.substring(base, 1, 5), F.lit("é"), F.substring(base, 7, 6))
    return c.select(F.initcap(F.when(F.col("c_custkey") % 4 == 3, typo).otherwise(base)).alias("name"))


SQL_SPELLED = """c AS (SELECT c_custkey, substr(translate(md5(CAST(c_custkey // 4 AS VARCHAR)), '0123456789abcdef', 'bcdfghjklmnpqrst'), 1, 12) AS b FROM customer),
 w AS (SELECT CASE WHEN c_custkey % 4 = 3 THEN substr(b, 1, 5) || 'é' || substr(b, 7, 6) ELSE b END AS x FROM c),
 names AS (SELECT upper(x[1]) || x[2:] AS name, count(*) AS n FROM w GROUP BY 1),
 f AS (SELECT name, n, strip_accents(lower(name)) AS f FROM names),
 p AS (SELECT a.name AS a, b.name AS b, a.f AS fa, b.f AS fb FROM f a JOIN f b ON a.name < b.name),
 lcs AS (SELECT a, b, fa, fb, 0 AS i, list_transform(range(0, length(fb) + 1), lambda x: 0) AS r FROM p
  UNION ALL SELECT a, b, fa, fb, i + 1, list_prepend(0, list_transform(range(1, length(fb) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(r[k + 1], r[k] + CASE WHEN fa[i + 1] = fb[k] THEN 1 ELSE 0 END))))) FROM lcs WHERE i < length(fa)),
 close AS (SELECT a, b FROM lcs WHERE i = length(fa) AND 2.0 * r[len(r)] / (length(fa) + length(fb)) >= 0.85),
 better AS (SELECT x.name AS a, y.name AS b, y.n AS nb FROM (SELECT a, b FROM close UNION ALL SELECT b, a FROM close) c
   JOIN f x ON c.a = x.name JOIN f y ON c.b = y.name WHERE (-y.n, y.name) < (-x.n, x.name)),
 state AS (SELECT name, CAST(NULL AS VARCHAR) AS canon, 0 AS turn, true AS open FROM f
  UNION ALL SELECT s.name, coalesce(s.canon, CASE WHEN bool_or(k.canon = k.name) AND coalesce(arg_min(k.canon IS NOT DISTINCT FROM k.name, (-b.nb, b.b)) FILTER (k.canon IS NULL OR k.canon = k.name), false)
      THEN arg_min(b.b, (-b.nb, b.b)) FILTER (k.canon = k.name)
    WHEN count(b.b) FILTER (k.canon IS NULL OR k.canon = k.name) = 0 THEN s.name END), s.turn + 1, true
   FROM state s LEFT JOIN better b ON s.name = b.a LEFT JOIN state k ON k.name = b.b WHERE s.turn < 12 GROUP BY s.name, s.canon, s.turn)"""


@query("ag22_canonical_names", f"WITH RECURSIVE {SQL_SPELLED} SELECT f.name, n, canon FROM f JOIN state ON f.name = state.name WHERE turn = 12")
def ag22(spark, folder):
    return rs.canonical_names(spelled(spark, folder)).select("name", "n", "canon")


@query("ag23_dedupe_captures", r"""WITH c AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS key, url,
   CASE WHEN regexp_matches(url, '\.html') THEN 2 ELSE 99 END AS r, page_id FROM pages)
 SELECT key, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, page_id, url) AS n FROM c) WHERE n = 1""")
def ag23(spark, folder):
    c = table(spark, folder, "pages").select(
        F.col("url").alias("original"), F.col("page_id").alias("timestamp"),
        F.when(F.col("url").rlike(r"\.html"), "text/html").otherwise("other").alias("mimetype"))
    return rs.dedupe_captures(c, ids.url_host("original")).select("key", F.col("original").alias("url"))


SQL_NEAR = """p AS (SELECT DISTINCT round(43 + ((c_custkey * c_custkey * 31) % 10007) / 50000.0, 4) AS lat,
   round(2 + ((c_custkey * c_custkey * c_custkey * 17 + c_custkey * 7) % 10009) / 50000.0, 4) AS lon FROM customer)"""


@query("gr4_near_pairs", f"""WITH {SQL_NEAR}, d AS (SELECT a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2,
   sqrt(((a.lon - b.lon) * 111320.0 * cos(radians(a.lat))) ** 2 + ((a.lat - b.lat) * 110574.0) ** 2) AS m
  FROM p a JOIN p b ON (a.lat < b.lat OR (a.lat = b.lat AND a.lon < b.lon)) AND abs(a.lat - b.lat) < 0.01)
 SELECT lat1, lon1, lat2, lon2, round(m, 3) AS metres FROM d WHERE m < 150""")
def gr4(spark, folder):
    return rs.near_pairs(points(spark, folder), 150.0).withColumn("metres", F.round("metres", 3))


def points(spark, folder):
    # Remainders first: they are those of the powers of the key, which a long does not hold for large keys.
    k = F.col("c_custkey").cast("bigint")
    a, b = k % 10007, k % 10009
    return table(spark, folder, "customer").select(
        F.round(43 + ((a * a * 31) % 10007) / 50000.0, 4).alias("lat"),
        F.round(2 + ((b * b * b * 17 + b * 7) % 10009) / 50000.0, 4).alias("lon"))


@query("gr4_farthest", f"""WITH {SQL_NEAR} SELECT round(max(sqrt(((2.1 - lon) * 111320.0 * cos(radians(43.1::DOUBLE))) ** 2
  + ((43.1 - lat) * 110574.0) ** 2)), 3) AS metres FROM p""")
def gr4_far(spark, folder):
    return rs.farthest(points(spark, folder), 43.1, 2.1).select(F.round("metres", 3).alias("metres"))


# ---- lists and lookups -----------------------------------------------------------------------------------

@query("jn6_new_and_gone", r"""WITH u AS (SELECT url LIKE 'https:%' AS site, 'https://' || regexp_extract(url, '://([^/?#]*)', 1)
   || regexp_replace(regexp_extract(url, '://[^/?#]*/([a-z]+)', 1), '[^a-z]', '_', 'g') AS u FROM pages),
 s AS (SELECT DISTINCT u FROM u WHERE site), k AS (SELECT DISTINCT u FROM u WHERE NOT site)
 SELECT u AS url, 'new' AS change FROM s WHERE u NOT IN (SELECT u FROM k) AND contains(u, 'example.com')
 UNION ALL SELECT u, 'gone' FROM k WHERE u NOT IN (SELECT u FROM s)""")
def jn6(spark, folder):
    p = table(spark, folder, "pages").select(
        F.col("url").startswith("https:").alias("site"),
        F.concat(F.lit("https://"), ids.url_host("url"),
                 F.regexp_extract("url", r"://[^/?#]*/([a-z]+)", 1)).alias("url"))
    return rs.new_and_gone(p.where("site"), p.where("NOT site"), "url", F.col("url").contains("example.com"))


@query("jn9_enrich_hits", """SELECT o_orderkey, c_name, n_name FROM orders
 LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def jn9(spark, folder):
    hits = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("item"))
    items = table(spark, folder, "customer").select(F.col("c_custkey").alias("item"), "c_name",
                                                    F.col("c_nationkey").alias("meeting"))
    meetings = table(spark, folder, "nation").select(F.col("n_nationkey").alias("meeting"), "n_name")
    return rs.enrich_hits(hits, items, meetings, "item", "meeting").select("o_orderkey", "c_name", "n_name")


@query("jn10_parcel_mentions", """SELECT l_partkey AS parcel, p_name, count(*) AS mentions, count(DISTINCT l_orderkey) AS meetings,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def jn10(spark, folder):
    mentions = li(spark, folder).select(F.col("l_partkey").alias("parcel"), F.col("l_orderkey").alias("meeting"))
    meetings = table(spark, folder, "orders").select(F.col("o_orderkey").alias("meeting"), "o_orderdate")
    parcels = table(spark, folder, "part").select(F.col("p_partkey").alias("parcel"), "p_name")
    m = rs.parcel_mentions(mentions, meetings, parcels, "parcel", "meeting", "o_orderdate")
    return m.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("jn11_folder_lookup", """SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS "has_R",
  coalesce(bool_or(l_returnflag = 'A'), false) AS "has_A", coalesce(bool_or(l_returnflag = 'N'), false) AS "has_N"
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def jn11(spark, folder):
    files = li(spark, folder).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return rs.folder_lookup(table(spark, folder, "orders").select("o_orderkey"), files, "o_orderkey",
                            "l_returnflag", ["R", "A", "N"])


@query("jn12_place_links", """SELECT l_orderkey, p_brand AS place, p_size > 25 AS confirmed, count(DISTINCT l_linenumber) AS pages,
  min(l_linenumber) AS first_page, max(l_linenumber) AS last_page
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def jn12(spark, folder):
    m = li(spark, folder).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.col("p_brand").alias("place"), "l_linenumber", "p_size")
    return rs.place_links(m.where("p_size > 25").drop("p_size"), m.where("p_size <= 25").drop("p_size"),
                          ["l_orderkey", "place"], "l_linenumber")


@query("jn13_money_threads", """SELECT o_custkey AS thread, count(*) AS n FROM orders WHERE o_totalprice > 400000
 GROUP BY 1 HAVING count(*) >= 2""")
def jn13(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("thread"), "o_totalprice")
    return rs.money_threads(o, "thread", F.col("o_totalprice") > 400000)


@query("jn14_verify_hashes", """SELECT page_id, sha256(html) = CASE WHEN contains(url, '#') THEN sha256(url) ELSE sha256(html) END
 AS matches FROM pages""")
def jn14(spark, folder):
    p = table(spark, folder, "pages")
    records = p.select("page_id", F.when(F.col("url").contains("#"), ids.content_hash("url"))
                       .otherwise(ids.content_hash("html")).alias("expected"))
    actual = p.select("page_id", ids.content_hash("html").alias("sha256"))
    return vs.verify_hashes(records, actual, "page_id").select("page_id", "matches")


@query("ft6_meeting_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'""")
def ft6(spark, folder):
    meetings = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return se.meeting_items(li(spark, folder), meetings, "l_orderkey", "o_orderdate", "1998-10-03").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("ft6_list_meetings", """SELECT date, meetings FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS meetings
 FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1)
""")
def ft6_list(spark, folder):
    days = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count("*").alias("meetings"))
    return se.meetings_between(days, "date", "1998-01-01", "1998-12-31").withColumn(
        "date", F.date_format("date", "yyyy-MM-dd"))


# ---- versions ---------------------------------------------------------------------------------------------

SQL_VERSIONS = """o AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS page FROM (
   SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 n0 AS (SELECT doc_id, page, CASE page % 6 WHEN 1 THEN upper(replace(line, 'ß', 'ss')) || '.' WHEN 2 THEN ' ' || line || ' ' ELSE line END AS line
   FROM o WHERE page % 6 <> 3),
 n AS (SELECT * FROM n0 UNION ALL SELECT doc_id, max(page) + 1, 'added page ' || max(page) FROM o GROUP BY doc_id)"""
SQL_DIFF = rf"""{SQL_VERSIONS}, d AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.page, n.page) AS page,
  CASE WHEN o.page IS NULL THEN 'added' WHEN n.page IS NULL THEN 'removed' WHEN o.line = n.line THEN 'unchanged'
   WHEN trim(regexp_replace(o.line, '\s+', ' ', 'g')) = trim(regexp_replace(n.line, '\s+', ' ', 'g')) THEN 'whitespace_only'
   ELSE 'changed' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.page = n.page)"""


def two_versions(spark, folder):
    """Old and new pages: every document's lines, and the same lines edited by a fixed rule."""
    lines = F.split("text", "\n")
    d = table(spark, folder, "documents")
    old = d.select("doc_id", F.posexplode(lines).alias("p", "text")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("page"), "text")
    edited = F.transform(lines, lambda x, i: F.struct((i + 1).cast("bigint").alias("page"), F.when(
        (i + 1) % 6 == 1, F.concat(F.upper(F.replace(x, F.lit("ß"), F.lit("ss"))), F.lit("."))).when(
        (i + 1) % 6 == 2, F.concat(F.lit(" "), x, F.lit(" "))).when((i + 1) % 6 == 3, F.lit(None)).otherwise(x)
        .alias("text")))
    extra = F.array(F.struct((F.size(lines) + 1).cast("bigint").alias("page"),
                             F.concat(F.lit("added page "), F.size(lines).cast("string")).alias("text")))
    new = d.select("doc_id", F.inline(F.filter(F.concat(edited, extra), lambda x: x["text"].isNotNull())))
    return old, new


@query("jn8_diff_pages", f"WITH {SQL_DIFF} SELECT doc_id, CAST(page AS BIGINT) AS page, status FROM d")
def jn8(spark, folder):
    old, new = two_versions(spark, folder)
    return vs.diff_pages(old, new, ["doc_id", "page"]).select("doc_id", "page", "status")


@query("df3_diff_summary", f"""WITH {SQL_DIFF} SELECT doc_id, count(*) FILTER (status = 'unchanged') AS unchanged,
  count(*) FILTER (status = 'whitespace_only') AS whitespace_only, count(*) FILTER (status = 'changed') AS changed,
  count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
  count(*) FILTER (status <> 'added') AS pages_before, count(*) FILTER (status <> 'removed') AS pages_after,
  bool_or(status IN ('changed', 'added', 'removed')) AS text_changed FROM d GROUP BY doc_id""")
def df3(spark, folder):
    old, new = two_versions(spark, folder)
    return vs.diff_summary(vs.diff_pages(old, new, ["doc_id", "page"]), ["doc_id"])


@query("df2_line_diff", f"""WITH {SQL_VERSIONS}, c AS (SELECT doc_id, line, sum(k) AS net FROM (
   SELECT doc_id, line, 1 AS k FROM n UNION ALL SELECT doc_id, line, -1 FROM o) GROUP BY ALL HAVING sum(k) <> 0)
 SELECT doc_id, line, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(net) AS BIGINT) AS n FROM c""")
def df2(spark, folder):
    old, new = two_versions(spark, folder)
    return vs.line_changes(old.withColumnRenamed("text", "line"), new.withColumnRenamed("text", "line"), ["doc_id"])


def _sql_chain(name: str, pairs: str, keys: str) -> str:
    """The longest chain of pairs (i, j) rising on both sides: piles by repeated minima, then back from the last pile."""
    same = " AND ".join(f"q.{k} = c.{k}" for k in keys.split(", "))
    mine = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""{name}_left AS (SELECT {keys}, i, j, 1 AS p FROM {pairs} UNION ALL SELECT {keys}, i, j, p + 1 FROM (
    SELECT *, min(j) OVER (PARTITION BY {keys} ORDER BY i) AS least FROM {name}_left) x WHERE j > least),
 {name}_pile AS (SELECT {keys}, i, j, max(p) AS p FROM {name}_left GROUP BY ALL),
 {name} AS (SELECT {keys}, p, max(i) AS i, arg_max(j, i) AS j FROM (SELECT *, max(p) OVER (PARTITION BY {keys}) AS last FROM {name}_pile) x
   WHERE p = last GROUP BY {keys}, p
  UNION ALL SELECT {mine}, c.p - 1, max(q.i), arg_max(q.j, q.i) FROM {name} c JOIN {name}_pile q
   ON {same} AND q.p = c.p - 1 AND q.i < c.i AND q.j < c.j GROUP BY {mine}, c.p)"""


SQL_ORDERED = rf"""WITH RECURSIVE t0 AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{sq.LINE_END}') AS l FROM documents),
 t AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM t0),
 o AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
 n AS (SELECT doc_id, j, l[j % len(l) + 1] || CASE WHEN j % 5 = 2 THEN ' (read)' ELSE '' END AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM t)),
 once AS (SELECT doc_id, i, j FROM (SELECT doc_id, line, min(i) AS i FROM o GROUP BY ALL HAVING count(*) = 1)
   JOIN (SELECT doc_id, line, min(j) AS j FROM n GROUP BY ALL HAVING count(*) = 1) USING (doc_id, line)),
 {_sql_chain("c1", "once", "doc_id")},
 og AS (SELECT o.doc_id, o.i, o.line, c1.j IS NULL AS free, count(c1.j) OVER (PARTITION BY o.doc_id ORDER BY o.i) AS g FROM o LEFT JOIN c1 ON o.doc_id = c1.doc_id AND o.i = c1.i),
 ng AS (SELECT n.doc_id, n.j, n.line, c1.i IS NULL AS free, count(c1.i) OVER (PARTITION BY n.doc_id ORDER BY n.j) AS g FROM n LEFT JOIN c1 ON n.doc_id = c1.doc_id AND n.j = c1.j),
 again AS (SELECT doc_id, g, i, j FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g, line ORDER BY i) AS k FROM og WHERE free)
   JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, g, line ORDER BY j) AS k FROM ng WHERE free) USING (doc_id, g, line, k)),
 {_sql_chain("c2", "again", "doc_id, g")},
 a AS (SELECT doc_id, i, j FROM c1 UNION ALL SELECT doc_id, i, j FROM c2),
 so AS (SELECT o.doc_id, o.i, o.line, a.j, count(a.j) OVER (PARTITION BY o.doc_id ORDER BY o.i) AS k, max(a.j) OVER (PARTITION BY o.doc_id ORDER BY o.i) AS aj
   FROM o LEFT JOIN a ON o.doc_id = a.doc_id AND o.i = a.i),
 sn AS (SELECT n.doc_id, n.j, n.line, a.i, count(a.i) OVER (PARTITION BY n.doc_id ORDER BY n.j) AS k,
    min(a.i) OVER (PARTITION BY n.doc_id ORDER BY n.j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM n LEFT JOIN a ON n.doc_id = a.doc_id AND n.j = a.j),
 s AS (SELECT doc_id, i + coalesce(j, aj, 0) - k AS seq, CASE WHEN j IS NULL THEN '-' ELSE ' ' END AS c, line, i, j FROM so
   UNION ALL SELECT doc_id, j + coalesce(ni, len(l) + 1) - 1 - k, '+', line, NULL, j FROM sn JOIN t USING (doc_id) WHERE i IS NULL),
 w AS (SELECT *, count(i) OVER u AS no, count(j) OVER u AS nn, max(CASE WHEN c <> ' ' THEN seq END) OVER u AS pc,
   min(CASE WHEN c <> ' ' THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nc
   FROM s WINDOW u AS (PARTITION BY doc_id ORDER BY seq)),
 v AS (SELECT *, CASE WHEN seq - 1 = lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) THEN 0 ELSE 1 END AS opens FROM w WHERE seq - pc <= 3 OR nc - seq <= 3),
 h AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY seq) AS h FROM v),
 f AS (SELECT doc_id, h, count(i) AS lo, count(j) AS ln, coalesce(min(i), min(no)) AS bo, coalesce(min(j), min(nn)) AS bn,
   string_agg(c || line, chr(10) ORDER BY seq) AS body FROM h GROUP BY doc_id, h),
 e AS (SELECT doc_id, '--- old' || chr(10) || '+++ new' || chr(10) || string_agg('@@ -' || bo || CASE WHEN lo = 1 THEN '' ELSE ',' || lo END
   || ' +' || bn || CASE WHEN ln = 1 THEN '' ELSE ',' || ln END || ' @@' || chr(10) || body, chr(10) ORDER BY h) AS diff FROM f GROUP BY doc_id)"""


def read_twice(spark, folder):
    """Every document, and the same with its first line at the end and every fifth line marked."""
    def second(l):
        return F.transform(F.sequence(F.lit(1), F.size(l)), lambda i: F.concat(
            F.get(l, i % F.size(l)), F.when(i % 5 == 2, F.lit(" (read)")).otherwise(F.lit(""))))
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("old"), t.let(
        sq.lines_of("text"), lambda l: F.when(F.size(l) > 0, F.array_join(second(l), "\n"))).alias("new"))


@query("df2_unified_diff", f"{SQL_ORDERED} SELECT t.doc_id, coalesce(diff, '') AS diff FROM t LEFT JOIN e ON t.doc_id = e.doc_id")
def df2_ordered(spark, folder):
    return sq.unified_diff(read_twice(spark, folder), "old", "new").select("doc_id", "diff")


@query("df2_edits", f"""{SQL_ORDERED} SELECT doc_id, CASE WHEN c = '-' THEN 'removed' ELSE 'added' END AS change,
  CAST(coalesce(i, j) AS INT) AS no, line FROM s WHERE c <> ' '""")
def df2_edits(spark, folder):
    return sq.edits(read_twice(spark, folder), "old", "new").select("doc_id", F.inline("edits"))


@query("df1_similarity", """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: replace(strip_accents(lower(x)), 'ß', 's')) AS l FROM documents),
 p AS (SELECT doc_id, CAST(i AS INT) AS line, l[i] AS a, l[i + 1] AS b FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM l))
 SELECT doc_id, line, round(1 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) AS ratio FROM p WHERE length(a) > 0""")
def df1(spark, folder):
    """Every line beside the next one."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.replace(t.fold(x), F.lit("ß"), F.lit("s")))
    pairs = table(spark, folder, "documents").select("doc_id", t.settled(lines).alias("l")).where("size(l) > 1").select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(F.get("l", i - 1).alias("a"), F.get("l", i).alias("b")))))
    return pairs.where("length(col.a) > 0").select("doc_id", (F.col("pos") + 1).alias("line"), F.round(
        vs.similarity(F.col("col.a"), F.col("col.b")), 6).alias("ratio"))


@query("df1_matching_ratio")
def df1_exact(spark, folder):
    """Every line beside the next one; the only line of a document has none and no ratio."""
    pairs = table(spark, folder, "documents").select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", F.posexplode_outer(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("l") - 1, F.lit(1))), lambda i: F.struct(F.get("l", i - 1).alias("a"), F.get("l", i).alias("b")))))
    return pairs.select("doc_id", (F.col("pos") + 1).alias("line"), F.round(
        sq.matching_ratio(t.fold("col.a"), t.fold("col.b")), 6).alias("ratio"))


# ---- search -----------------------------------------------------------------------------------------------

SQL_INDEX = r"""rows AS (SELECT 'item' AS kind, CAST(doc_id AS VARCHAR) AS ref, lang, string_split(text, chr(10))[1] || ' ' || text AS b FROM documents
  UNION ALL SELECT 'summary', conv_id || '-' || turn, 'fr', text FROM conversations),
 tok AS (SELECT kind, ref, lang, unnest(regexp_extract_all(strip_accents(lower(b)), '[\p{L}\p{N}]+')) AS term FROM rows),
 len AS (SELECT kind, ref, count(*) AS doc_len FROM tok GROUP BY ALL),
 post AS (SELECT term, tok.kind, tok.ref, tok.lang, doc_len, count(*) AS tf FROM tok JOIN len USING (kind, ref) GROUP BY ALL)"""


def search_table(spark, folder):
    return se.search_rows(table(spark, folder, "documents"), table(spark, folder, "conversations"))


@query("ft2_build_index", f"WITH {SQL_INDEX} SELECT term, kind, ref, lang, doc_len, tf FROM post")
def ft2(spark, folder):
    return se.build_index(search_table(spark, folder)).withColumn("doc_len", F.col("doc_len").cast("bigint"))


SQL_BEST = f"""WITH {SQL_INDEX}, q AS (SELECT kind, ref, lang, doc_len, sum(CASE WHEN term = 'the' THEN tf ELSE 0 END) AS t0,
   sum(CASE WHEN term LIKE 'tion%' THEN tf ELSE 0 END) AS t1 FROM post WHERE term = 'the' OR term LIKE 'tion%' GROUP BY ALL),
 n AS (SELECT (SELECT count(*) FROM rows) AS n, (SELECT sum(doc_len) FROM len) / (SELECT count(*) FROM rows) AS avg,
   (SELECT count(*) FROM q WHERE t0 > 0) AS d0, (SELECT count(*) FROM q WHERE t1 > 0) AS d1)
 SELECT kind, ref, lang, round(
   greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * doc_len / avg)) +
   greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * doc_len / avg)), 6) AS score
 FROM q, n WHERE t0 > 0 AND t1 > 0 ORDER BY score DESC, kind, ref LIMIT 20"""


@query("ft3_search", SQL_BEST)
def ft3(spark, folder):
    path = shared_folder(spark, "index")
    se.store_index(search_table(spark, folder), path)
    return se.search(*se.stored_index(spark, path), "the Tion", 20)


@query("ft3_search_blocks", SQL_BEST)
def ft3_blocks(spark, folder):
    path = shared_folder(spark, "index")
    se.store_index(search_table(spark, folder), path)
    return se.search_stored(spark, path, "the Tion", 20)[0]


SQL_MARKED = r"""rows AS (SELECT 'item' AS kind, CAST(doc_id AS VARCHAR) AS ref, text AS body FROM documents
  UNION ALL SELECT 'summary', conv_id || '-' || turn, text FROM conversations),
 t AS (SELECT kind, ref, list_filter(string_split_regex(body, '[\s]+'), lambda x: x <> '') AS w FROM rows),
 f AS (SELECT kind, ref, w, list_transform(w, lambda x: CASE WHEN regexp_matches(strip_accents(lower(x)), '(^|[^\p{L}\p{N}])(the([^\p{L}\p{N}]|$)|tion)') THEN 1 ELSE 0 END) AS f FROM t),
 n AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(f[i:i + 23]), 0)) AS n FROM f),
 b AS (SELECT *, coalesce(list_position(n, list_max(n)), 1) AS i FROM n)
 SELECT kind, ref, CASE WHEN len(w) = 0 THEN NULL ELSE (CASE WHEN i > 1 THEN '…' ELSE '' END) || array_to_string(list_transform(range(i, least(i + 23, len(w)) + 1),
   lambda k: CASE WHEN f[k] = 1 THEN '[' || w[k] || ']' ELSE w[k] END), ' ') || CASE WHEN len(w) > i + 23 THEN '…' ELSE '' END END AS snippet FROM b"""


@query("ft4_highlight", f"WITH {SQL_MARKED}")
def ft4(spark, folder):
    words = se.parse_query("the tion")
    return search_table(spark, folder).select("kind", "ref", se.highlight("body", words).alias("snippet"))
