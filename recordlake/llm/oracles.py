"""SQL that must give the rows of the queries, where SQL can say it.

There is none for packing (tokenizer), sharding (CRC-32), SimHash (XXH64), the suffix arrays and the classifier:
tests compare those with brute force or a round trip.
"""
from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"
SYMBOL = "'[#*$%&|<>]'"

LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, i AS line, l[i] AS written, array_to_string(regexp_extract_all(l[i], {WORD}), ' ') AS words
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, line) AS place FROM lines),
firsts AS (SELECT words, min(place) AS place, string_split(words, ' ') AS w FROM placed WHERE words <> '' GROUP BY words),
long AS (SELECT place, words, w, len(w) AS n FROM firsts WHERE len(w) >= 10),
variants AS (SELECT place, pos, array_to_string(list_concat(w[1:pos - 1], w[pos + 1:n]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM long)),
replaced AS (SELECT place, place > min(place) OVER (PARTITION BY v, pos) AS later FROM variants),
left_out AS (SELECT greatest(v.place, l.place) AS place FROM variants v JOIN long l ON v.v = l.words),
gone AS (SELECT place FROM replaced WHERE later UNION SELECT place FROM left_out),
kept AS (SELECT p.doc_id, p.line, p.written FROM placed p LEFT JOIN firsts f ON p.place = f.place LEFT JOIN gone g ON p.place = g.place
  WHERE p.words = '' OR f.place IS NOT NULL AND g.place IS NULL)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(k.n, 0) AS n_kept
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(written, chr(10) ORDER BY line) AS text, count(*) AS n FROM kept GROUP BY doc_id) k
  ON d.doc_id IS NOT DISTINCT FROM k.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last,
  payload_bytes >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY payload_digest) AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN last END AS refers_to FROM m"""

TOP_K = """
WITH e AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0) AS size,
   coalesce(len(regexp_extract_all(text, {SYMBOL})), 0) AS symbols,
   (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/0'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / (1 / (1 + symbols / CAST(greatest(size, 1) AS DOUBLE))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
   3 * source_size AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
   - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), max(CASE WHEN cap > level * w THEN level END) OVER () * w), CAST(cap AS DOUBLE)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM t),
o AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) AS budget,
   sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
   FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs + CASE WHEN upto - size / 2.0 <= budget THEN 1 ELSE 0 END) * size AS taken FROM o"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, t, len(w) AS n_words, len(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars,
   len(regexp_extract_all(t, {SYMBOL})) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines,
   coalesce(p.n, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
   len(regexp_extract_all(t, '\p{{L}}')) AS letters FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
   OR 10 * n_symbols > n_words AND n_symbols > 3 OR word_chars < 2 * n_words OR word_chars > 15 * n_words
   OR 2 * n_dup_lines > len(lines) OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > letters
   OR 2 * len(regexp_extract_all(t, '[!?]{{2}}')) > n_words OR 2 * letters < word_chars
   OR 5 * n_distinct < n_words AND n_words < 1000 OR n_distinct < 10) AS kept FROM b"""

ORACLES = {"op1_line_dedup": LINE_DEDUP, "op3_warc": WARC, "op4_exact_top_k": TOP_K, "op5_mixing": MIXING, "op7_quality_rules": QUALITY_RULES}
