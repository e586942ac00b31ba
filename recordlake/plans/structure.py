"""Queries over lines, blocks, items and sentences (PF*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.operators import lines as ln
from recordlake.plans.catalog import query, table

# ---- SQL pieces shared by the checks below ------------------------------------------------------
FOLD = "strip_accents(lower({0}))"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def sql_sentences(text: str) -> str:
    """Array of sentences in RE2, which has no lookaround."""
    abbr = "|".join(lx.ABBREVIATIONS)
    marked = (rf"regexp_replace({SQUEEZE.format(text)}, '([.!?])\s+([A-ZÀ-Ý«“\"])', "
              r"'\1' || chr(1) || '\2', 'g')")
    heal = marked
    for _ in range(2):
        heal = (rf"regexp_replace({heal}, '(^|[ \x01])((?i:{abbr})|\p{{Lu}})(\.+)\x01', "
                r"'\1\2\3 ', 'g')")
    return (f"list_filter(list_transform(string_split({heal}, chr(1)), lambda s: trim(s)), "
            f"lambda s: s <> '')")


SQL_LINES = r"""raw AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT doc_id, list_transform(string_split(text, chr(10)),
      lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))) AS l FROM {src})),
seen AS (SELECT *, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)
           AS nb FROM raw),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no
          FROM seen WHERE NOT (line = '1' AND nb <= 3))"""

SQL_HEADING = r"""(length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 8 AND length(line) <= 140
 AND length(regexp_replace(line, '[^\p{Lu}]', '', 'g'))
     >= 0.85 * length(regexp_replace(line, '[^\p{L}]', '', 'g'))
 AND len(regexp_extract_all(line, '[A-Za-zÀ-ÿ]{2,}')) >= 2
 AND length(regexp_replace(line, '[^0-9]', '', 'g'))
     <= length(regexp_replace(line, '[^\p{L}]', '', 'g')))"""

SQL_TABLE = r"""(length(line) > 0 AND (
 length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.5 * length(line)
 OR (length(regexp_replace(line, '[^0-9]', '', 'g')) > 0.3 * length(line)
     AND NOT regexp_matches(line, '[A-Za-zÀ-ÿ]{4,}'))
 OR (len(regexp_extract_all(line, '-?\d{1,3}(?: \d{3})+(?:,\d+)?|-?\d+,\d+')) >= 2
     AND length(line) < 100)))"""

SQL_CAPS = r"""(length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 4
 AND len(string_split(line, ' ')) <= 3 AND NOT regexp_matches(line, '\p{Ll}')
 AND NOT regexp_matches(line, '\d') AND line <> '')"""

# Minutes written from the documents: every third line gets a heading made of its own first words,
# every fourth a bullet, every fifth a row of figures.
LAYOUT_SQL = """(SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)),
  lambda s, i: CASE i % 5
    WHEN 1 THEN upper(replace(substr(s, 1, 48), 'ß', 'ss')) || chr(10) || s
    WHEN 2 THEN '- ' || substr(s, 1, 40) || chr(10) || s
    WHEN 3 THEN '1 234,50 ' || CAST(i AS VARCHAR) || ' 200,10' || chr(10) || '12 500,00 7,5' || chr(10) || s
    WHEN 4 THEN substr(s, 1, 12) || chr(10) || s
    ELSE s || chr(10) END), 'string_agg', chr(10)) AS text FROM documents)"""


def laid_out(spark, folder):
    """The same layout on the Spark side: derived from every document, inside its row."""
    s = F.split("text", "\n")

    def lay(x, i):
        k = (i + 1) % 5
        return (F.when(k == 1, F.concat(F.upper(F.replace(F.substring(x, 1, 48), F.lit("ß"),
                                                          F.lit("ss"))), F.lit("\n"), x))
                .when(k == 2, F.concat(F.lit("- "), F.substring(x, 1, 40), F.lit("\n"), x))
                .when(k == 3, F.concat(F.lit("1 234,50 "), (i + 1).cast("string"),
                                       F.lit(" 200,10\n12 500,00 7,5\n"), x))
                .when(k == 4, F.concat(F.substring(x, 1, 12), F.lit("\n"), x))
                .otherwise(F.concat(x, F.lit("\n"))))
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.transform(s, lay), "\n").alias("text"))


def doc_pages(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.lit(1).alias("page"), "text")


@query("pf1_clean_lines", f"WITH {SQL_LINES.format(src='documents')} "
                          "SELECT doc_id, line_no, line FROM lines")
def pf1(spark, folder):
    return ln.page_lines(doc_pages(spark, folder)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("pf2_is_heading", f"WITH {SQL_LINES.format(src=LAYOUT_SQL)} SELECT doc_id, line_no, "
                         f"{SQL_HEADING} AS heading FROM lines")
def pf2(spark, folder):
    pages = laid_out(spark, folder).withColumn("page", F.lit(1))
    return ln.page_lines(pages).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                                       t.is_heading("line").alias("heading"))


@query("pf3_is_table_line", f"WITH {SQL_LINES.format(src=LAYOUT_SQL)} SELECT doc_id, line_no, "
                            f"{SQL_TABLE} AS table_line FROM lines")
def pf3(spark, folder):
    pages = laid_out(spark, folder).withColumn("page", F.lit(1))
    return ln.page_lines(pages).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                                       t.is_table_line("line").alias("table_line"))


# The same blocks by windows over lines: a start is "hard start, or chained to a start", which is
# the later of two running positions.
SQL_BLOCKS = r"""WITH @LINES@,
kinds AS (SELECT *, @CAPS@ AS caps, @HEAD@ AS head, @TAB@ AS tab,
  regexp_matches(line, '^\s*(?:[-–—•➢►▪>*]|\d{1,2}[.)])\s+') AS bul FROM lines),
-- capital lines that follow a heading: chained as long as every line before is a capital line
chain AS (SELECT *,
  max(CASE WHEN head AND NOT caps THEN line_no END) OVER w AS hard,
  max(CASE WHEN NOT (caps AND line <> '') THEN line_no END) OVER w AS brk,
  lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_no
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY line_no
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chain2 AS (SELECT *, lag(hard) OVER w1 AS p_hard, lag(brk) OVER w1 AS p_brk,
  max(CASE WHEN head AND caps THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_x
  FROM chain WINDOW w1 AS (PARTITION BY doc_id ORDER BY line_no)),
k1 AS (SELECT doc_id, line_no, line,
  CASE WHEN line = '' THEN '_'
       WHEN caps AND ((p_hard IS NOT NULL AND p_hard >= coalesce(p_brk, 0))
                      OR (p_x IS NOT NULL AND p_x > coalesce(p_brk, 0))) THEN 'm'
       WHEN head THEN 'h' WHEN tab THEN 't' WHEN bul THEN 'b' ELSE 'p' END AS k FROM chain2),
k2 AS (SELECT *, lag(k) OVER w AS pk, lag(line) OVER w AS pl, lead(k) OVER w AS nk,
  lead(line) OVER w AS nl,
  max(CASE WHEN k NOT IN ('_', 't') THEN line_no END) OVER wb AS non_t,
  max(CASE WHEN k = 't' THEN line_no END) OVER wb AS last_t
  FROM k1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no),
  wb AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k3 AS (SELECT *,
  (length(pl) < 50 AND NOT regexp_matches(pl, '[.:;!?)»”",]$') AND regexp_matches(pl, '^\p{Lu}')
    AND len(string_split(pl, ' ')) BETWEEN 1 AND 6) AS p_title,
  (length(line) < 50 AND NOT regexp_matches(line, '[.:;!?)»”",]$') AND regexp_matches(line, '^\p{Lu}')
    AND len(string_split(line, ' ')) BETWEEN 1 AND 6) AS title,
  regexp_matches(line, '^\p{Lu}') AS up, coalesce(regexp_matches(nl, '^\p{Lu}'), false) AS n_up
  FROM k2),
k4 AS (SELECT *, CASE
  WHEN k IN ('h', 'b') THEN true
  WHEN k = 't' THEN NOT (last_t IS NOT NULL AND last_t > coalesce(non_t, 0))
  WHEN k = 'p' THEN coalesce(pk, '_') <> 'p' OR
       (regexp_matches(pl, '[.:;!?)»”"]$') AND length(pl) < 70 AND up)
  ELSE false END AS h,
  k = 'p' AND coalesce(pk, '_') = 'p' AND p_title AND up AS c FROM k3),
k5 AS (SELECT *,
  max(CASE WHEN h THEN line_no END) OVER wr AS h_at,
  max(CASE WHEN NOT c THEN line_no END) OVER wr AS brk_at
  FROM k4 WINDOW wr AS (PARTITION BY doc_id ORDER BY line_no)),
k6 AS (SELECT *, h OR (c AND h_at IS NOT NULL AND h_at >= coalesce(brk_at, 0)) AS start FROM k5),
k7 AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)
   AS block_no FROM k6 WHERE k <> '_'),
blocks AS (SELECT doc_id, CAST(block_no AS BIGINT) AS block_no,
  max(CASE WHEN start THEN CASE k WHEN 'h' THEN 'heading' WHEN 't' THEN 'table'
      WHEN 'b' THEN 'bullet'
      ELSE CASE WHEN title AND (nk = 'b' OR (nk = 'p' AND n_up)) THEN 'subheading'
           ELSE 'paragraph' END END END) AS kind,
  CASE WHEN max(CASE WHEN k IN ('t', 'u') THEN 1 ELSE 0 END) = 1
    THEN string_agg(line, chr(10) ORDER BY line_no)
    ELSE string_agg(CASE WHEN k = 'b' THEN regexp_replace(line,
      '^\s*(?:[-–—•➢►▪>*]|\d{1,2}[.)])\s+', '') ELSE line END, ' ' ORDER BY line_no) END AS text
  FROM k7 GROUP BY doc_id, block_no)
""".replace("@CAPS@", SQL_CAPS).replace("@HEAD@", SQL_HEADING).replace("@TAB@", SQL_TABLE).replace(
    "@LINES@", SQL_LINES.format(src=LAYOUT_SQL))


@query("pf4_blocks", SQL_BLOCKS + "SELECT doc_id, block_no, kind, text FROM blocks")
def pf4(spark, folder):
    docs = ln.with_blocks(laid_out(spark, folder), ln.single_page()).drop("text")
    return docs.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("block_no"),
        F.col("b.kind").alias("kind"), F.col("b.text").alias("text"))


@query("pf5_split_items", SQL_BLOCKS + r""",
sect AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY block_no) AS s FROM blocks),
stat AS (SELECT doc_id, s, min(block_no) AS first_no,
  sum(CASE WHEN kind IN ('paragraph', 'bullet')
      THEN length(regexp_replace(text, '[^a-zà-ÿ]', '', 'g')) ELSE 0 END) AS prose,
  bool_or(kind = 'paragraph' AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 8) AS sent
  FROM sect WHERE s >= 2 GROUP BY doc_id, s),
opened AS (SELECT doc_id, s, s = 2 OR NOT (prose < 40 OR NOT sent) AS o FROM stat),
numbered AS (SELECT b.*, sum(CASE WHEN b.kind = 'heading' AND o.o THEN 1 ELSE 0 END)
    OVER (PARTITION BY b.doc_id ORDER BY b.block_no) AS item_no,
    b.kind = 'heading' AND o.o AS is_title
  FROM sect b JOIN opened o ON b.doc_id = o.doc_id AND b.s = o.s)
SELECT doc_id, CAST(item_no AS BIGINT) AS item_no, max(CASE WHEN is_title THEN text END) AS title,
  coalesce(string_agg(CASE WHEN NOT is_title THEN text END, chr(10) ORDER BY block_no), '') AS body
FROM numbered GROUP BY doc_id, item_no""")
def pf5(spark, folder):
    docs = ln.with_blocks(laid_out(spark, folder), ln.single_page()).drop("text")
    return ln.items(docs).select("doc_id", F.col("item_no").cast("bigint").alias("item_no"),
                                 F.col("title_raw").alias("title"), "body")


@query("pf7_sentences", f"""SELECT doc_id, unnest(s) AS sentence,
 CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS seq
 FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)""")
def pf7(spark, folder):
    return sentences_of(table(spark, folder, "documents"))


def sentences_of(docs, key="doc_id", text="text"):
    return docs.select(key, F.posexplode(t.sentences(text)).alias("pos", "sentence")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("seq"), "sentence")


@query("pf10_eligible", r"""SELECT d.doc_id,
  NOT (coalesce(l.toxic, 0) = 1 OR contains(lower(title), 'withheld')
       OR regexp_matches(strip_accents(lower(title)),
                         '(^|[^a-z0-9_])(vente|cession|vendre|ceder)($|[^a-z0-9_])')) AS eligible,
  body <> '' AND length(regexp_replace(body, '[^0-9]', '', 'g')) > 0.12 * length(body) AS table_item
 FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title,
         CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END
           AS body FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def pf10(spark, folder):
    from recordlake.operators import linking
    docs = linking.as_items(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return docs.select(F.col("item_id").alias("doc_id"), linking.eligible().alias("eligible"),
                       ((F.col("text") != "") & t.mostly_numbers("text")).alias("table_item"))


@query("pf11_prose", f"""WITH s AS (SELECT doc_id, unnest(s) AS sentence,
   unnest(range(1, len(s) + 1)) AS seq FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)),
 w AS (SELECT *, list_filter(string_split(sentence, ' '), lambda x: x <> '') AS w FROM s)
 SELECT doc_id, CAST(seq AS BIGINT) AS seq,
  len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) < 6
   AND len(list_filter(w[2:], lambda x: regexp_matches(x, '^\\p{{Lu}}'))) <= 0.4 * (len(w) - 1) AS prose,
  length(regexp_replace(sentence, '[^0-9]', '', 'g')) > 0.12 * length(sentence) AS figures FROM w""")
def pf11(spark, folder):
    s = sentences_of(table(spark, folder, "documents"))
    return s.select("doc_id", "seq", t.looks_like_prose("sentence").alias("prose"),
                    t.mostly_numbers("sentence").alias("figures"))


CATEGORY_RULES = [("question", r"\?"), ("figures", r"\d{3,}"), ("contact", r"@"),
                  ("long", r"^.{200,}"), ("short", r"^.{0,40}$")]


@query("pf14_first_match_category", f"""SELECT category, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT CASE {' '.join(f"WHEN regexp_matches(sentence, '{p}') THEN '{c}'" for c, p in CATEGORY_RULES)}
  ELSE 'other' END AS category
 FROM (SELECT unnest({sql_sentences('text')}) AS sentence FROM documents)) GROUP BY 1""")
def pf14(spark, folder):
    from recordlake.operators.signals import first_match
    s = sentences_of(table(spark, folder, "documents"))
    return s.groupBy(first_match("sentence", CATEGORY_RULES, "other").alias("category")).agg(
        F.count("*").alias("n"))


@query("pf15_page_needs_ocr", """SELECT doc_id, length(trim(text, ' ' || chr(10))) < 50
  OR (frac >= 0.25 AND length(trim(text, ' ' || chr(10))) < 300) AS needs_ocr,
  conf < 85 OR low > 0.15 AS weak FROM (SELECT doc_id, text, (doc_id % 40) / 100.0 AS frac,
  CAST(60 + doc_id % 40 AS DOUBLE) AS conf, (doc_id % 20) / 100.0 AS low FROM documents)""")
def pf15(spark, folder):
    from recordlake.operators.analytics import page_needs_ocr, weak_ocr
    d = table(spark, folder, "documents").select(
        "doc_id", "text", ((F.col("doc_id") % 40) / 100.0).alias("frac"),
        (60 + F.col("doc_id") % 40).cast("double").alias("conf"),
        ((F.col("doc_id") % 20) / 100.0).alias("low"))
    return d.select("doc_id", page_needs_ocr("text", "frac").alias("needs_ocr"),
                    weak_ocr("conf", "low").alias("weak"))


@query("pf16_field_allow_list", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def pf16(spark, folder):
    from recordlake.operators.privacy import allow_fields
    return allow_fields(table(spark, folder, "customer"),
                        ["c_custkey", "c_mktsegment", "c_nationkey", "not_there"])


@query("pf6_reattach_captions")
def pf6(spark, folder):
    docs = ln.with_blocks(laid_out(spark, folder), ln.single_page()).drop("text")
    keys = F.transform(F.filter("blocks", lambda b: b["kind"] == "bullet"), lambda b: t.title_key(b["text"]))
    items = ln.items(docs.withColumn("agenda_keys", F.array_distinct(keys)))
    out = ln.reattach_captions(items)
    return out.select("doc_id", F.col("item_no").cast("bigint").alias("item_no"),
                      F.size("blocks").alias("blocks"))
