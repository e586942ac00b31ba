"""Queries over privacy and quality (PV*, QC*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from recordlake.functions import ids
from recordlake.functions import text as t
from recordlake.operators import privacy as pv
from recordlake.operators import quality as qc
from recordlake.plans.catalog import query, table
from recordlake.plans.minutes import people_pages, person, sql_name
from recordlake.plans.structure import sentences_of, sql_sentences

TEST_KEY = "k" * 40      # fixed test key; a deployment reads its own from the environment
_PAD = TEST_KEY.encode().ljust(64, b"\0")
_IN, _OUT = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()


def sql_hmac(message: str) -> str:
    return f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({message}))))"


SQL_NORM = ("list_aggregate(list_sort(list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^0-9a-z]+'), "
            "lambda x: x <> '')), 'string_agg', ' ')")


@query("pv2_pseudonym", f"""SELECT c_custkey, 'M-' || left({sql_hmac("'master|' || " + SQL_NORM.format('c_name'))}, 12) AS master_id,
  'P-' || left({sql_hmac("'public|' || c_nationkey || '|' || " + SQL_NORM.format('c_name'))}, 10) AS public_id,
  'P-' || left({sql_hmac("'public|' || " + SQL_NORM.format('c_name'))}, 10) AS global_id FROM customer""")
def pv2(spark, folder):
    c = table(spark, folder, "customer")
    return c.select("c_custkey", ids.master_id("c_name", TEST_KEY).alias("master_id"),
                    ids.public_id("c_name", "c_nationkey", TEST_KEY).alias("public_id"),
                    ids.public_id("c_name", "c_nationkey", TEST_KEY, "global").alias("global_id"))


@query("pv3_person_registry", f"""WITH a AS (SELECT DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN
    split_part({sql_name('o_custkey')}, ' ', 2) || ' ' || split_part({sql_name('o_custkey')}, ' ', 1) ELSE {sql_name('o_custkey')} END AS name,
   year(o_orderdate) AS document, month(o_orderdate) AS page, o_orderstatus AS field FROM orders),
 m AS (SELECT *, 'M-' || left({sql_hmac("'master|' || " + SQL_NORM.format('name'))}, 12) AS master_id FROM a)
 SELECT master_id, count(DISTINCT name) AS names_seen, min(name) AS first_name, count(DISTINCT (document, page, field)) AS appearances
 FROM m GROUP BY master_id""")
def pv3(spark, folder):
    o = table(spark, folder, "orders")
    name = person("o_custkey")
    turned = F.concat_ws(" ", F.substring_index(name, " ", -1), F.substring_index(name, " ", 1))
    a = o.select(F.when(F.col("o_orderpriority") == "1-URGENT", turned).otherwise(name).alias("name"),
                 F.year("o_orderdate").alias("document"), F.month("o_orderdate").alias("page"),
                 F.col("o_orderstatus").alias("field"))
    return pv.registry_summary(pv.person_registry(a, TEST_KEY))


# ---- redaction over the documents: the first three words of every benchmark passage are the names ----------

SQL_BENCH_NAMES = r"""nm AS (SELECT DISTINCT list_filter(regexp_split_to_array(strip_accents(lower(w[1] || ' ' || w[2] || ' ' || w[3])), '[^0-9a-z]+'), lambda x: x <> '') AS tk
   FROM (SELECT string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark) WHERE len(w) >= 3),
 rot AS (SELECT DISTINCT unnest([tk[1] || '[\s\-]+' || tk[2] || '[\s\-]+' || tk[3], tk[2] || '[\s\-]+' || tk[3] || '[\s\-]+' || tk[1], tk[3] || '[\s\-]+' || tk[1] || '[\s\-]+' || tk[2]]) AS r FROM nm WHERE len(tk) = 3),
 hit AS (SELECT doc_id, count(*) AS rotations, sum(len(regexp_extract_all(f, '(?:^|[^0-9a-z])' || r || '(?:$|[^0-9a-z])'))) AS n FROM (
   SELECT doc_id, strip_accents(lower(text)) AS f FROM documents), rot WHERE regexp_matches(f, '(?:^|[^0-9a-z])' || r || '(?:$|[^0-9a-z])') GROUP BY doc_id)"""


def bench_names(spark, folder):
    w = t.words("text")
    return table(spark, folder, "benchmark").where(F.size(w) >= 3).select(
        F.array_join(F.slice(w, 1, 3), " ").alias("name"))


@query("pv4_redact", f"WITH {SQL_BENCH_NAMES} SELECT doc_id, CAST(n AS INT) AS redactions FROM hit")
def pv4(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    out = pv.redact(d, bench_names(spark, folder), ["doc_id"], "doc_id", TEST_KEY)
    return out.where("redactions > 0").select("doc_id", "redactions")


@query("pv8_leak_check", f"WITH {SQL_BENCH_NAMES} SELECT doc_id, 'registered name' AS problem FROM hit")
def pv8(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return pv.leak_check(d, bench_names(spark, folder), ["doc_id"])


@query("pv5_scrub", f"""SELECT c_custkey, 'Le conseil entend [name withheld] puis ' || {sql_name('o')} || ' et Monsieur ' || {sql_name('o')}
  || '. [name withheld] ajoute. Avec [names withheld] pour finir.' AS scrubbed FROM (SELECT c_custkey, c_custkey + 1 AS o FROM customer)""")
def pv5(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") + 1).alias("other"))
    me, kept = person("c_custkey"), person("other")
    last = F.substring_index(me, " ", -1)
    turned = F.concat_ws(" ", last, F.substring_index(me, " ", 1))
    text = F.concat(F.lit("Le conseil entend "), turned, F.lit(" puis "), kept, F.lit(" et Monsieur "), kept,
                    F.lit(". "), last, F.lit(" ajoute. Avec "), me, F.lit(", M. "), me, F.lit(" et "), turned,
                    F.lit(" pour finir."))
    rows = c.select("c_custkey", text.alias("text"), F.array(me).alias("names"), F.array(kept).alias("keep"),
                    F.array(F.lower(last)).alias("caps"))
    return rows.select("c_custkey", pv.scrub("text", F.col("names"), F.col("keep"), F.col("caps")).alias("scrubbed"))


@query("pv6_allowed", f"""WITH f AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE DATE '1996-01-01' END AS lo,
   CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE DATE '1998-12-31' END AS hi FROM customer WHERE c_acctbal > 2000)
 SELECT o_orderkey, coalesce(CASE WHEN f.c_custkey IS NULL THEN false WHEN lo IS NULL THEN true
   WHEN o_orderstatus = 'P' THEN false ELSE CAST(o_orderdate AS DATE) BETWEEN lo AND hi END, false) AS allowed
 FROM orders LEFT JOIN f ON o_custkey = f.c_custkey""")
def pv6(spark, folder):
    bounded = F.col("c_mktsegment") != "MACHINERY"
    figures = table(spark, folder, "customer").where("c_acctbal > 2000").select(
        person("c_custkey").alias("name"), F.when(bounded, F.lit("1996-01-01").cast("date")).alias("valid_from"),
        F.when(bounded, F.lit("1998-12-31").cast("date")).alias("valid_to"))
    mentions = table(spark, folder, "orders").select("o_orderkey", person("o_custkey").alias("name"), F.when(
        F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("doc_date"))
    return pv.allowed(mentions, figures).select("o_orderkey", "allowed")


def sql_pid(doc, name):
    return f"'P-' || left({sql_hmac(chr(39) + 'public|' + chr(39) + f' || {doc} || ' + chr(39) + '|' + chr(39) + ' || ' + SQL_NORM.format(name))}, 10)"


@query("pv7_redact_documents", f"""WITH c AS (SELECT c_custkey, c_acctbal > 2000 AS fig, c_custkey + 1 AS o FROM customer),
 x AS (SELECT c_custkey, o, EXISTS (SELECT 1 FROM customer y WHERE y.c_custkey = c.o AND y.c_acctbal > 2000) AS ofig, fig FROM c)
 SELECT c_custkey AS document, 'Vendeur : ' || {sql_pid('c_custkey', sql_name('c_custkey'))} || chr(10) || 'Il salue '
  || CASE WHEN ofig THEN {sql_name('o')} ELSE {sql_pid('c_custkey', sql_name('o'))} END || '.' AS text, CASE WHEN ofig THEN 1 ELSE 2 END AS redactions
 FROM x WHERE o IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT c_custkey, 'Vendeur : ' || {sql_pid('c_custkey', sql_name('c_custkey'))} || chr(10) || 'Il salue ' || {sql_name('o')} || '.', 1
 FROM x WHERE o NOT IN (SELECT c_custkey FROM customer)""")
def pv7(spark, folder):
    c = table(spark, folder, "customer")
    pages = c.select(F.col("c_custkey").alias("document"), F.lit(1).alias("page"), F.lit("2020-01-01").cast("date").alias("doc_date"),
                     F.concat(F.lit("Vendeur : "), person("c_custkey"), F.lit("\nIl salue "),
                              person_after(), F.lit(".")).alias("text"))
    none = F.lit(None).cast("date")
    figures = c.where("c_acctbal > 2000").select(person("c_custkey").alias("name"), none.alias("valid_from"), none.alias("valid_to"))
    registry = c.select(person("c_custkey").alias("name"))
    return pv.redact_documents(pages, registry, figures, TEST_KEY).select("document", "text", "redactions")


def person_after():
    from recordlake.plans.minutes import FIRST
    n = F.col("c_custkey") + 1
    return F.concat(F.element_at(F.array(*[F.lit(f) for f in FIRST]), (n % 8 + 1).cast("int")), F.lit(" V"),
                    F.translate(n.cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("OR"))


SQL_WORDS = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ][\p{L}\p{N}_’''\-]*')) AS w FROM documents),
 common AS (SELECT strip_accents(w) AS word, count(*) AS n FROM w WHERE w = lower(w) GROUP BY 1 HAVING count(*) >= 3)"""


@query("pv9_corpus_vocabulary", f"""WITH {SQL_WORDS}, c AS (SELECT c_custkey FROM customer UNION SELECT c_custkey + 1 FROM customer UNION SELECT c_custkey + 2 FROM customer),
 r AS (SELECT DISTINCT unnest([lower(split_part({sql_name('c_custkey')}, ' ', 1)), lower(split_part({sql_name('c_custkey')}, ' ', 2))]) AS word FROM c)
 SELECT 'common' AS kind, word FROM common UNION ALL SELECT 'roster', word FROM r
 WHERE word NOT IN (SELECT word FROM common) AND length(word) >= 3 AND word NOT IN ('etaient', 'absents')""")
def pv9(spark, folder):
    common = pv.common_words(table(spark, folder, "documents"))
    roster = pv.roster_words(people_pages(spark, folder), common, ["Etaient"])
    return common.select(F.lit("common").alias("kind"), "word").unionByName(
        roster.select(F.lit("roster").alias("kind"), "word"))


@query("pv10_mask_by_vocabulary", rf"""WITH {SQL_WORDS},
 roster AS (SELECT DISTINCT strip_accents(lower(n)) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ][\p{{L}}\p{{N}}_’''\-]*')) AS n FROM benchmark)
   WHERE regexp_matches(n, '^\p{{Lu}}') AND length(n) >= 3 AND strip_accents(lower(n)) NOT IN (SELECT word FROM common)),
 s AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS seq, unnest(s) AS sentence FROM (
   SELECT doc_id, {sql_sentences('text')} AS s FROM documents)),
 k AS (SELECT doc_id, seq, unnest(regexp_extract_all(sentence, '(^|[^A-Za-zÀ-ÿ\p{{L}}\p{{N}}_’''\-]+)[\p{{N}}_’''\-]*[A-Za-zÀ-ÿ][\p{{L}}\p{{N}}_’''\-]*')) AS g FROM s),
 c AS (SELECT *, regexp_extract(g, '[A-Za-zÀ-ÿ][\p{{L}}\p{{N}}_’''\-]*$') AS w, g IS NOT NULL AS ok FROM k),
 m AS (SELECT doc_id, seq, w, row_number() OVER () AS i, substr(g, 1, length(g) - length(w)) AS gap FROM c)
 SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(count(*) AS INT) AS n_masked FROM m
 WHERE (strip_accents(lower(w)) IN (SELECT word FROM roster) OR regexp_matches(w, '^\p{{Lu}}') AND strip_accents(lower(w)) NOT IN (SELECT word FROM common)
  AND gap <> '' AND NOT regexp_matches(rtrim(gap), '[.!?:;«“"(]$') AND NOT (rtrim(gap) = '' AND gap = ''))
  AND NOT (w IN ('Mme', 'Mmes', 'Mlle', 'Mlles', 'Mr', 'Me', 'Mes', 'Monsieur', 'Madame', 'Mademoiselle', 'Messieurs', 'Mesdames'))
 GROUP BY ALL""")
def pv10(spark, folder):
    common = pv.common_words(table(spark, folder, "documents"))
    names = F.filter(F.regexp_extract_all("text", F.lit(pv.WORD), 0), lambda w: w.rlike(r"^\p{Lu}"))
    roster = (table(spark, folder, "benchmark").select(F.explode(F.transform(names, lambda w: t.fold(w))).alias("word"))
              .where("length(word) >= 3").distinct().join(common.select("word"), "word", "left_anti"))
    s = sentences_of(table(spark, folder, "documents")).withColumn("id", F.concat_ws("-", "doc_id", "seq"))
    return pv.mask_by_vocabulary(s, common, roster, "id").where("n_masked > 0").select("doc_id", "seq", "n_masked")


@query("pv11_mask_unmask", r"""SELECT conv_id, turn, CAST(len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS INT) AS tokens,
  md5(text) AS restored FROM conversations""")
def pv11(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", pv.mask_tokens("text", "[A-Z][a-z]+").alias("m"))
    return c.select("conv_id", "turn", F.size("m.mapping").alias("tokens"),
                    F.md5(pv.unmask(F.col("m.text"), F.col("m.mapping"))).alias("restored"))


@query("pv12_suppress_sensitive", """SELECT d.doc_id, CASE WHEN coalesce(toxic, 0) = 1 THEN '[withheld]' ELSE string_split(text, chr(10))[1] END AS title,
  CASE WHEN coalesce(toxic, 0) = 1 THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def pv12(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.split("text", "\n").alias("lines"), "text",
        (F.coalesce("toxic", F.lit(0)) == 1).alias("sensitive"))
    out = pv.suppress_sensitive(d, ["lines"], ["text"], neutral="[withheld]")
    return out.select("doc_id", "title", F.size("lines").cast("bigint").alias("lines"))


@query("pv13_approval_gate", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'awaiting' WHEN quality = 0 THEN 'stale'
  WHEN n_chars > 2000 AND toxic = 1 THEN 'undecided' ELSE 'approved' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def pv13(spark, folder):
    d = table(spark, folder, "documents")
    hashed = d.select("doc_id", ids.content_hash("text").alias("sha256"),
                      F.when(F.col("n_chars") > 2000, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
                      .alias("review_pages"))
    approvals = table(spark, folder, "labels").join(d.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, ids.content_hash("text")).otherwise("old").alias("approved_sha256"),
        F.array(F.lit(2)).alias("withheld_pages"),
        F.when(F.col("toxic") == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("accepted_pages"))
    return pv.approval_gate(hashed, approvals).select("doc_id", "state")


# ---- quality ------------------------------------------------------------------------------------------------

SQL_NUM = r"list_sort(list_transform(regexp_extract_all({0}, '\d[\d\s .,]*\d|\d'), lambda x: regexp_replace(x, '\D', '', 'g')))"
SQL_PAIRS = """p AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS output FROM conversations a
   JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


def pairs(spark, folder):
    c = table(spark, folder, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"), (F.col("turn") + 1).alias("next"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("output"))
    return a.join(b, ["conv_id", "next"]).drop("next")


@query("qc1_numbers_preserved", f"""SELECT doc_id, {SQL_NUM.format('text')} = {SQL_NUM.format('o')} AS same, len({SQL_NUM.format('text')}) AS numbers
 FROM (SELECT doc_id, text, CASE WHEN lang = 'en' THEN replace(text, '1', '') ELSE replace(text, ',', ' ,') END AS o FROM documents)""")
def qc1(spark, folder):
    from recordlake.functions.numbers import number_cores
    d = table(spark, folder, "documents")
    o = F.when(F.col("lang") == "en", F.replace("text", F.lit("1"), F.lit(""))).otherwise(
        F.replace("text", F.lit(","), F.lit(" ,")))
    return d.withColumn("o", o).select("doc_id", qc.numbers_preserved("text", "o").alias("same"),
                                       F.size(number_cores("text")).cast("bigint").alias("numbers"))


@query("qc2_preserved", r"""SELECT l_orderkey, l_partkey, l_linenumber % 3 <> 0 AS refs, l_suppkey % 4 = 1 AS placeholders FROM lineitem""")
def qc2(spark, folder):
    li = table(spark, folder, "lineitem")
    ref = F.concat(F.lit("L 2121-"), (1 + F.col("l_partkey") % 90).cast("string"))
    copies = F.repeat(F.lit("⟦N1⟧ "), (F.col("l_suppkey") % 4).cast("int"))
    out = F.concat(copies, F.when(F.col("l_linenumber") % 3 == 0, F.lit("the act")).otherwise(F.replace(ref, F.lit(" "), F.lit(""))))
    p = li.select("l_orderkey", "l_partkey", F.concat(F.lit("Vu l'article "), ref, F.lit(" lu")).alias("s"), out.alias("o"))
    return p.select("l_orderkey", "l_partkey", qc.refs_preserved("s", "o").alias("refs"),
                    qc.placeholders_preserved("o", F.array(F.lit("⟦N1⟧"))).alias("placeholders"))


@query("qc3_length_plausible", rf"""WITH {SQL_PAIRS} SELECT conv_id, turn, length(output) / greatest(length(source), 1) BETWEEN 0.5 AND 2.0 AS plausible,
  NOT regexp_matches(output, '^\s*(?i:here is|here''s|voici|translation\s*:|de vertaling|hier is|sure|certainly)') AS clean,
  trim(output) <> '' AS filled FROM p""")
def qc3(spark, folder):
    return pairs(spark, folder).select("conv_id", "turn", qc.length_plausible("source", "output").alias("plausible"),
                                       qc.no_preamble("output").alias("clean"), qc.not_empty("output").alias("filled"))


def _sql_ratio(words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: x IN ({listed}))) / len(w) END)"


def _qc4_sql():
    from recordlake.functions import lexicons as lx
    fr, en = _sql_ratio(lx.STOP_WORDS["fr"]), _sql_ratio(lx.STOP_WORDS["en"])
    return f"""SELECT doc_id, len(regexp_extract_all(low, '[a-zà-ÿ]+')) < 8 OR ({en} > {fr} AND {fr} < 0.12) AS target FROM (
 SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[a-zà-ÿ’'']+') AS w FROM documents)"""


@query("qc4_is_target_language", _qc4_sql())
def qc4(spark, folder):
    return table(spark, folder, "documents").select("doc_id", qc.is_target_language("text", "text", "en").alias("target"))


@query("qc5_glossary_honoured", r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM benchmark),
 g AS (SELECT w[1] AS term, list(DISTINCT w[len(w)]) AS words FROM w WHERE length(w[1]) >= 3 GROUP BY 1),
 bad AS (SELECT DISTINCT doc_id FROM documents, g WHERE contains(lower(text), term) AND NOT list_bool_or(list_transform(words, lambda x: contains(lower(text), x))))
 SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM bad) AS honoured FROM documents""")
def qc5(spark, folder):
    """The glossary: first words of the benchmark passages, for which their last words are accepted."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), 1)
    glossary = table(spark, folder, "benchmark").select(F.get(words, 0).alias("term"), F.element_at(words, -1).alias("accepted")).where("length(term) >= 3")
    d = table(spark, folder, "documents").select("doc_id", "text")
    return qc.glossary_honoured(d, glossary, "doc_id", "text", "text").select("doc_id", F.col("glossary_honoured").alias("honoured"))


SQL_FIG = r"list_transform(list_filter(regexp_extract_all({0}, '\d[\d\s .,]*\d|\d'), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 3 OR regexp_matches(x, '\d[.,]\d')), lambda x: regexp_replace(x, '\D', '', 'g'))"


@query("qc6_figures_in_source", f"""WITH {SQL_PAIRS} SELECT conv_id, turn, len(list_filter({SQL_FIG.format('output')}, lambda x: NOT list_contains({SQL_NUM.format('source')}, x))) = 0 AS figures,
  len({SQL_FIG.format('output')}) AS n FROM p""")
def qc6(spark, folder):
    return pairs(spark, folder).select("conv_id", "turn", qc.figures_in_source("source", "output").alias("figures"),
                                       F.size(qc.important_figures("output")).cast("bigint").alias("n"))


@query("qc7_fallback_merge", f"""WITH {SQL_PAIRS} SELECT conv_id, turn, ok AS passed, CASE WHEN ok THEN output ELSE source || ' [kept]' END AS text FROM (
  SELECT *, length(output) / greatest(length(source), 1) BETWEEN 0.5 AND 2.0 AS ok FROM p)""")
def qc7(spark, folder):
    p = pairs(spark, folder)
    return qc.fallback_merge(p, qc.length_plausible("source", "output"), "source", "output", "[kept]").select(
        "conv_id", "turn", "passed", "text")


@query("qc8_validate_rows", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup,
   l_returnflag IN ('A', 'N') AS flag_ok, l_quantity < 49 AS qty_ok FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN NOT flag_ok THEN 'flag' END, CASE WHEN NOT qty_ok THEN 'quantity' END,
  CASE WHEN dup THEN 'unique key' END) AS broken FROM r WHERE dup OR NOT flag_ok OR NOT qty_ok""")
def qc8(spark, folder):
    li = table(spark, folder, "lineitem")
    bad = qc.validate_rows(li, ["l_orderkey", "l_linenumber"],
                           {"flag": F.col("l_returnflag").isin("A", "N"), "quantity": F.col("l_quantity") < 49})
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("broken", ",").alias("broken"))
