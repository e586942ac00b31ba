"""Queries over sources, sinks, digests and streams (SR*, SK*, DG1, ST*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import ids
from recordlake.functions import text as t
from recordlake.operators import linking as lk
from recordlake.operators import signals as sg
from recordlake.plans.catalog import query, table
from recordlake.plans.digests import whats_new
from recordlake.plans.threads import canonical, items_of
from recordlake.plans.timelines import LEDGER_SQL, SALES_SQL, SQL_LEDGER
from recordlake.session import shared_folder
from recordlake.sources import readers as rd
from recordlake.sources import sinks as sk
from recordlake.streaming import jobs


# ---- sources ---------------------------------------------------------------------------------------------

def records(spark, folder):
    """Orders as record documents, their lines as pages."""
    pages = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page"),
        F.col("l_returnflag").alias("status"), F.col("l_extendedprice").cast("string").alias("text"),
        F.col("l_partkey").alias("part_key"))
    meetings = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("document_id"), F.lit(1).alias("version"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), F.lit("orders").alias("source"),
                 F.lit("tentative").alias("status")).alias("meeting_date"))
    return sk.nested(meetings, pages, "o_orderkey", "page", ["status", "text", "part_key"])


@query("sr1_read_records", """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, strftime(any_value(o_orderdate), '%Y-%m-%d') AS date,
  count(l_linenumber) AS pages, coalesce(max(l_linenumber), 0) AS last_page,
  count(*) FILTER (l_returnflag = 'R') AS returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def sr1(spark, folder):
    path = shared_folder(spark, "records")
    sk.write_nested_json(records(spark, folder).withColumnRenamed("decisions", "pages"), path)
    documents, pages, _ = rd.read_records(spark, path, multi_line=False)
    counted = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"),
                                               F.count_if(F.col("status") == "R").alias("returned"))
    return documents.join(counted, "document_id", "left").select(
        "document_id", F.col("meeting_date.value").alias("date"), F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce("last_page", F.lit(0)).alias("last_page"), F.coalesce("returned", F.lit(0)).alias("returned"))


@query("sk3_nested_json", """SELECT o_orderkey, 0 AS part, count(l_linenumber) AS n,
  coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_returnflag, CAST(l_extendedprice AS VARCHAR), l_partkey), '') AS decisions
 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def sk3(spark, folder):
    d = records(spark, folder)
    rows = F.coalesce("decisions", F.array().cast(d.schema["decisions"].dataType))
    return d.select("o_orderkey", "part", F.size(rows).cast("bigint").alias("n"), F.array_join(F.transform(
        rows, lambda x: F.concat_ws(":", x["page"].cast("string"), x["part_key"].cast("string"))), ",")
        .alias("decisions"))


@query("sr2_read_ledger", f"""WITH l AS ({SQL_LEDGER}) SELECT year, count(*) AS n, CAST(sum(sc) AS DOUBLE) AS credit,
  count(DISTINCT compte) AS accounts FROM l GROUP BY year""")
def sr2(spark, folder):
    path = shared_folder(spark, "ledger")
    spark.sql(LEDGER_SQL, lineitem=table(spark, folder, "lineitem")).write.partitionBy("year").json(path)
    rows = rd.read_ledger(spark, path + "/year=*", multi_line=False)
    return rows.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        F.count("*").alias("n"), F.sum("sc").cast("double").alias("credit"),
        F.count_distinct("compte").alias("accounts"))


@query("sr3_read_sales", """SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation, count(*) AS n, max(l_extendedprice) AS price
 FROM lineitem WHERE l_suppkey % 3 <> 2 GROUP BY 1""")
def sr3(spark, folder):
    path = shared_folder(spark, "sales")
    key = F.col("row_no.l_suppkey") % 3
    code = F.when(key == 0, F.lit("99001")).when(key == 1, F.lit(None).cast("string")).otherwise("88002")
    rows = spark.sql(SALES_SQL, lineitem=table(spark, folder, "lineitem")).withColumn("code_commune", code)
    order = sorted((f.strip().split(" ")[0] for f in rd.SALES.split(",")), reverse=True)     # as little as a real file's
    rows.select(F.lit("x").alias("numero_disposition"), *order, F.lit("1,5").alias("lot1")).write.option("header", True).csv(path)
    return rd.read_sales(spark, path, "99001").groupBy("id_mutation").agg(
        F.count("*").alias("n"), F.max("valeur_fonciere").alias("price"))


SQL_HTML = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("head", "script", "style", "noscript"):
    SQL_HTML = rf"regexp_replace({SQL_HTML}, '(?is)<{_tag}\b.*?</{_tag}\s*>', '', 'g')"
SQL_HTML = rf"regexp_replace({SQL_HTML}, '(?i)<br\s*/?>|</?(?:p|div|tr|li|h1|h2|h3|h4|table|ul|ol|blockquote)\b[^>]*>', chr(10), 'g')"
SQL_HTML = rf"regexp_replace(regexp_replace({SQL_HTML}, '(?i)</t[dh]\s*>', ' ', 'g'), '<[^>]*>', '', 'g')"
SQL_HTML = f"replace(replace(replace(replace({SQL_HTML}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
SQL_TIDY = ("list_filter(list_transform(string_split(" + SQL_HTML + r", chr(10)), lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))), lambda s: s <> '')")


@query("sr4_html_to_text", f"SELECT page_id, len(l) AS lines, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT page_id, {SQL_TIDY} AS l FROM pages)")
def sr4(spark, folder):
    p = table(spark, folder, "pages").select("page_id", F.filter(F.split(rd.html_to_text("html"), "\n"),
                                                                 lambda s: s != "").alias("l"))
    return p.select("page_id", F.size("l").cast("bigint").alias("lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("sr5_extract_links", r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
   unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
   unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS i FROM pages),
 r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link, href, label, i FROM a WHERE href LIKE '/%'),
 f AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY i) AS n FROM r WHERE lower(href) LIKE '%n')
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS link_no, link AS url, regexp_extract(href, '[^/]*$') AS filename,
  label AS link_text FROM f WHERE n = 1""")
def sr5(spark, folder):
    links = rd.extract_links(table(spark, folder, "pages").select("page_id", "url", "html"), "n")
    return links.select("page_id", F.col("link_no").cast("bigint").alias("link_no"), "url", "filename", "link_text")


@query("sr6_front_matter", """SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents""")
def sr6(spark, folder):
    d = table(spark, folder, "documents")
    files = d.select("doc_id", F.concat(F.lit('---\nlang: "'), "lang", F.lit('"\nsource: '), "source", F.lit("\nchars: "),
                                        F.col("n_chars").cast("string"), F.lit("\n---\n> a notice\n\n"), "text").alias("raw"))
    f = files.select("doc_id", rd.front_matter("raw").alias("f"))
    return f.select("doc_id", F.col("f.meta")["lang"].alias("lang"), F.col("f.meta")["source"].alias("source"),
                    F.col("f.meta")["chars"].cast("bigint").alias("n_chars"), F.md5("f.body").alias("digest"))


@query("sr7_read_captures", """SELECT CAST(page_id AS VARCHAR) AS timestamp, url AS original, 'text/html' AS mimetype, length(html) AS length FROM pages""")
def sr7(spark, folder):
    path = shared_folder(spark, "captures")
    p = table(spark, folder, "pages")
    lines = p.select(F.concat(F.to_json(F.array(F.col("page_id").cast("string"), F.col("url"), F.lit("text/html"),
                                                F.length("html").cast("string"))), F.lit(",")).alias("value"))
    lines.write.text(path)
    return rd.read_captures(spark, path).withColumn("length", F.col("length").cast("bigint"))


# ---- sinks -------------------------------------------------------------------------------------------------

@query("sk1_write_derived", """SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'meetings', count(DISTINCT source) FROM documents""")
def sk1(spark, folder):
    path = shared_folder(spark, "derived")
    d = table(spark, folder, "documents")
    meetings = d.groupBy("source").agg(F.count("*").alias("items"))
    sk.write_derived({"documents": d, "meetings": meetings}, path, {"documents": "lang"})
    back = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            for name in ("documents", "meetings")]
    return back[0].unionByName(back[1])


@query("sk2_csv_safe", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal ELSE CAST(c_acctbal AS VARCHAR) END AS balance,
  CASE WHEN c_nationkey = 3 THEN '' WHEN c_nationkey = 4 THEN '''=' || c_name ELSE c_name END AS name FROM customer""")
def sk2(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.when(
        F.col("c_nationkey") == 3, F.lit(None)).when(F.col("c_nationkey") == 4, F.concat(F.lit("="), "c_name"))
        .otherwise(F.col("c_name")).alias("name"))
    path = shared_folder(spark, "csv")
    sk.write_csv_safe(c, ["c_custkey", "balance", "name"], path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.coalesce(x, F.lit("")).alias(x) for x in back.columns])


@query("sk4_publish_snapshot", """SELECT lang, count(*) AS n, count(*) FILTER (coalesce(quality, 1) = 0) AS rewritten FROM documents d
 LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def sk4(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    stored = d.select("doc_id", F.when(F.coalesce("quality", F.lit(1)) == 0, F.lit("old")).otherwise(
        ids.content_hash("text")).alias("input_sha256"))
    path = shared_folder(spark, "published")
    now = d.select("doc_id", "lang", "text")
    sk.publish_snapshot(now, path, "lang")
    redo = sk.changed_only(now, stored, "doc_id", F.col("text")).groupBy("lang").agg(F.count("*").alias("rewritten"))
    return sk.read_snapshot(spark, path).groupBy("lang").agg(F.count("*").alias("n")).join(redo, "lang", "left").withColumn(
        "rewritten", F.coalesce("rewritten", F.lit(0)))


@query("sk5_manifest", """SELECT 'n_orders' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'n_lineitem', CAST(count(*) AS VARCHAR) FROM lineitem
 UNION ALL SELECT 'newest', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'layer', 'derived'""")
def sk5(spark, folder):
    return sk.build_manifest({"orders": table(spark, folder, "orders"), "lineitem": table(spark, folder, "lineitem")},
                             ("orders", "o_orderdate"), "derived")


# ---- digest ------------------------------------------------------------------------------------------------

@query("dg1_whats_new")
def dg1(spark, folder):
    base = items_of(spark, folder)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("grp") * 30)
    members, _ = lk.issue_threads(base, terms=False)
    threads = lk.thread_summary(canonical(members), base.select("grp").distinct()).withColumn(
        "last", F.date_add(F.lit("2024-01-01").cast("date"), F.col("last") * 30))
    items = base.select(day.alias("date"), "title", "sensitive", t.sentences("text").alias("sentences"), sg.item_topics("title", "text").alias("topics"),
                        F.when(F.col("deferred"), F.array(F.struct(F.lit("deferred").alias("type"), F.col("title").alias("sentence"))))
                        .otherwise(F.array().cast("array<struct<type:string,sentence:string>>")).alias("followups"))
    return whats_new(items, threads)


# ---- streams ------------------------------------------------------------------------------------------------

def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return jobs.file_stream(spark, folder, "events.parquet", schema)


@query("st1_ingest_versions", """WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value <= 300)
 SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
  CASE WHEN p IS NULL THEN 'new' ELSE 'changed' END AS status FROM c WHERE p IS DISTINCT FROM event_type""")
def st1(spark, folder):
    path = shared_folder(spark, "ingest")
    fetches = event_stream(spark, folder).select("user_id", "event_id", "ts", F.when(
        F.col("value") <= 300, F.col("event_type")).alias("event_type"))
    jobs.ingest_versions(fetches, path, path + "/_checkpoint", "user_id", ["ts", "event_id"], "event_type",
                         F.date_trunc("day", F.col("ts"))).awaitTermination()
    return spark.read.parquet(f"{path}/versions").select("user_id", "event_id", "event_type", "version", "status")


def hits(events):
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
    return events.select("user_id", "event_id", seconds.alias("seconds"))


SQL_LIMIT = """h AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT user_id, n, event_id, 0::BIGINT AS wait, [s] AS kept FROM h WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN len(k) >= 2 THEN greatest(1, CAST(trunc(k[len(k) - 1] + 21600.0 - s) AS BIGINT) + 1) ELSE 0 END,
   CASE WHEN len(k) >= 2 THEN k ELSE list_append(k, s) END
   FROM (SELECT h.*, list_filter(w.kept, lambda x: x > h.s - 21600.0) AS k FROM w JOIN h ON h.user_id = w.user_id AND h.n = w.n + 1) x)
 SELECT user_id, event_id, wait FROM w"""


@query("st2_rate_limit", f"WITH RECURSIVE {SQL_LIMIT}")
def st2(spark, folder):
    path = shared_folder(spark, "limit")
    stream = event_stream(spark, folder).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    limited = jobs.rate_limit(stream, "user_id", "ts", "event_id", 2, 6 * 3600.0)
    return jobs.run_to_table(limited, path + "/out", path + "/_checkpoint")


@query("st2_rate_limit_batch", f"WITH RECURSIVE {SQL_LIMIT}")
def st2_batch(spark, folder):
    e = table(spark, folder, "events")
    return jobs.rate_limit_batch(hits(e), "user_id", "seconds", "event_id", F.floor(F.col("seconds") / 86400), 2, 6 * 3600.0)


@query("st3_watch_new", """SELECT user_id, min(event_id) > -1 AS seen FROM events WHERE event_type <> 'error'
 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY user_id""")
def st3(spark, folder):
    path = shared_folder(spark, "watch")
    known = table(spark, folder, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    new = jobs.watch_new(event_stream(spark, folder).select("user_id", "event_type"), known, "user_id", F.col("event_type") != "error")
    return jobs.run_to_table(new, path + "/out", path + "/_checkpoint").select("user_id", F.lit(True).alias("seen"))


@query("st4_topic_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st4(spark, folder):
    path = shared_folder(spark, "counts")
    stream = event_stream(spark, folder).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    jobs.topic_counts(stream, path + "/out", path + "/_checkpoint", "ts", "event_type").awaitTermination()
    return jobs.topic_table(spark, path + "/out", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("st5_result_cache", "SELECT sha256(text) AS key, max(length(text)) AS result FROM documents GROUP BY 1")
def st5(spark, folder):
    path = shared_folder(spark, "cache")
    schema = table(spark, folder, "documents").schema
    stream = jobs.file_stream(spark, folder, "documents.parquet", schema).select(
        ids.content_hash("text").alias("key"), "text")
    work = lambda df: df.select("key", F.length("text").cast("bigint").alias("result"))
    jobs.result_cache(stream, path + "/cache", path + "/_checkpoint", "key", work,
                      "key string, result bigint").awaitTermination()
    return spark.read.parquet(path + "/cache/results").select("key", "result")
