"""Sources: record files, ledgers, sales registers, captures, front matter, HTML pages."""
from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions import text as t

RECORD = """document_id STRING, version INT, is_current BOOLEAN, superseded_at TIMESTAMP, filename STRING,
 source_url STRING, source_sha256 STRING, source_bytes BIGINT,
 source_http STRUCT<etag: STRING, last_modified: STRING>,
 origin STRUCT<kind: STRING, original_url: STRING, wayback_timestamp: STRING, official_copy: STRING,
   mirror_path: STRING, mirror_url: STRING, date_hint_from_filename: STRING>,
 retrieved_at TIMESTAMP, meeting_date STRUCT<value: STRING, source: STRING, status: STRING>,
 draft_suspected BOOLEAN, page_count INT,
 pages ARRAY<STRUCT<page: INT, page_url: STRING, method: STRING, status: STRING, note: STRING,
   image_area_fraction: DOUBLE, text: STRING, text_sparse: STRING,
   ocr: STRUCT<mean_conf: DOUBLE, min_conf: INT, low_word_fraction: DOUBLE, words: INT>>>,
 _corrupt_record STRING"""

LEDGER = """compte STRING, sd DECIMAL(18,2), sc DECIMAL(18,2), obnetdeb DECIMAL(18,2), obnetcre DECIMAL(18,2),
 bal STRING, nomen STRING, budget STRING, cbudg STRING"""

SALES = """id_mutation STRING, date_mutation DATE, nature_mutation STRING, valeur_fonciere DOUBLE,
 adresse_numero STRING, adresse_suffixe STRING, adresse_nom_voie STRING, code_commune STRING,
 id_parcelle STRING, type_local STRING, surface_reelle_bati DOUBLE, nombre_pieces_principales INT,
 surface_terrain DOUBLE"""


def read_records(spark: SparkSession, path: str, multi_line: bool = True
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SR1: (documents, pages, quarantine) from one JSON file per document, or from JSON lines.

    Pages keep the keys of their document; unreadable files go to quarantine, the rest is read on.
    """
    raw = (spark.read.schema(RECORD).option("multiLine", multi_line)
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    good = raw.where(F.col("document_id").isNotNull()).drop("_corrupt_record")
    bad = raw.where(F.col("document_id").isNull()).select(
        F.col("_corrupt_record"), F.input_file_name().alias("file"))
    documents = good.drop("pages")
    pages = good.select("document_id", "version", F.explode_outer("pages").alias("p")).select(
        "document_id", "version", "p.*").where(F.col("page").isNotNull())
    return documents, pages, bad


def read_ledger(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SR2: account rows with the year taken from the file's name or folder."""
    rows = spark.read.schema(LEDGER).option("multiLine", multi_line).json(path)
    year = F.regexp_extract(F.col("_metadata.file_path"), r"(?:balances-|year=)(\d{4})", 1)
    return rows.select("*", year.try_cast("int").alias("year"))


def read_sales(spark: SparkSession, path: str, commune: str) -> DataFrame:
    """SR3: sales rows of one commune; rows without a code are kept.

    Columns are found by the names in the header, whatever their order and number; one that is missing, or a
    value that is no number or date, is null.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    fields = [f.strip().split(" ") for f in SALES.split(",")]
    rows = raw.select(*[(F.col(n).try_cast(kind) if n in raw.columns else F.lit(None).cast(kind)).alias(n)
                        for n, kind in fields])
    code = F.col("code_commune")
    return rows.where(code.isNull() | (code == "") | code.startswith(commune))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """SR7: rows of an archive listing, an array per line, the first line being the header.

    Lines are parsed one by one, so a listing of any length is split between tasks.
    """
    line = F.regexp_replace(F.col("value"), r"^\[?(?=\[)|,\s*$|(?<=\])\]\s*$", "")
    cells = F.from_json(line, "array<string>")
    return spark.read.text(path).select(cells.alias("c")).where(
        (F.size("c") >= 4) & (F.get("c", F.lit(0)) != "timestamp")).select(
        *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("timestamp", "original", "mimetype", "length"))])


def front_matter(c) -> Column:
    """SR6: struct(meta, body): the ``---`` header as a map, quotes stripped, notice lines dropped."""
    text = t.col(c)
    shape = r"(?s)^---\n(.*?)\n---\n(.*)$"
    head = F.regexp_extract(text, shape, 1)
    pairs = F.filter(F.split(head, "\n"), lambda s: s.contains(":"))
    entries = F.transform(pairs, lambda s: F.struct(
        F.trim(F.substring_index(s, ":", 1)).alias("key"),
        F.regexp_replace(F.trim(F.regexp_replace(s, r"^[^:]*:", "")), "^[\"']|[\"']$", "").alias("value")))
    body = F.when(text.rlike(shape), F.regexp_extract(text, shape, 2)).otherwise(text)
    return F.struct(F.map_from_entries(entries).alias("meta"),
                    F.regexp_replace(body, r"^(?:\s*>[^\n]*\n|\s*\n)+", "").alias("body"))


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """SR6 on files: one row per file."""
    files = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", front_matter("value").alias("f")).select("path", "f.meta", "f.body")


# ---- HTML ------------------------------------------------------------------------------------------------

# --- Fixed values: tags ---
DROPPED = ["head", "script", "style", "noscript"]
BLOCKS = "p|div|tr|li|h1|h2|h3|h4|table|ul|ol|blockquote"
# The names that end with a semicolon and stand for one character, as the standard library lists them.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and len(text) == 1}
_MARK = "\u0001"


def decode_entities(c) -> Column:
    """Named, decimal and hexadecimal references as the characters they stand for; others as written."""
    table = ENTITIES | {"nbsp": " "}
    names = F.map_from_arrays(*[F.split(F.lit(_MARK.join(xs)), _MARK) for xs in (table.keys(), table.values())])
    shape = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def decoded(piece, known):
        return t.let(F.regexp_extract(piece, shape, 1), lambda name: F.when(
            name == "", F.concat(F.lit("&"), piece)).otherwise(named(piece, name, known)))

    def named(piece, name, known):
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10)).when(
            name.startswith("#"), F.substring(name, 2, 9)).try_cast("int")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(name.startswith("#"), F.when(real, F.when(code == 160, " ").otherwise(
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))).otherwise(F.element_at(known, name))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    def joined(text):
        # the table is made once for a row, and only for rows with references
        return t.let(F.struct(F.split(text, "&").alias("ps"), names.alias("known")), lambda v: F.concat(
            F.get(v["ps"], F.lit(0)), F.array_join(F.transform(
                F.slice(v["ps"], 2, F.size(v["ps"])), lambda p: decoded(p, v["known"])), "")))
    return t.let(t.col(c), lambda text: F.when(text.contains("&"), joined(text)).otherwise(text))


def html_to_text(c) -> Column:
    """SR4: visible text as lines; a chain of pattern replacements inside the row."""
    out = F.regexp_replace(t.col(c), r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)</t[dh]\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    return tidy(decode_entities(out))


def tidy(c) -> Column:
    """Control characters and doubled blanks dropped, one blank line at most between paragraphs."""
    out = F.replace(t.col(c), F.lit("\u0019"), F.lit("’"))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f\x7f]", "")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t ]+", " "), r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(out, r"^\s+|\s+$", ""), F.lit("\n"))


def _resolved(href: Column, base: Column) -> Column:
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/|$))", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(site, href))
            .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href)))


def _without_dots(url: Column) -> Column:
    """`.` and `..` in the path taken out, never above the site."""
    shape = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)(/[^?#]*)(.*)$"

    def path(parts):
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(
            x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(
            x == ".", acc).otherwise(F.concat(acc, F.array(x))))
        folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
        return t.let(kept, lambda k: F.when((F.size(k) == 0), "/").otherwise(
            F.concat(F.lit("/"), F.array_join(k, "/"), folder)))
    dotted = url.rlike(r"^[^?#]*/\.{1,2}(?:/|$|[?#])")
    return F.when(dotted, F.concat(F.regexp_extract(url, shape, 1), t.let(F.split(F.substring(F.regexp_extract(url, shape, 2), 2, 1 << 30), "/"), path),
                                   F.regexp_extract(url, shape, 3))).otherwise(url)


def extract_links(pages: DataFrame, suffix: str, html: str = "html", base: str = "url") -> DataFrame:
    """SR5: links of each page whose path ends in the suffix, first occurrence, in page order."""
    anchor = (r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>")
    found = F.regexp_extract_all(html, F.lit(anchor), 0)
    part = lambda a, *groups: F.concat(*[F.regexp_extract(a, anchor, g) for g in groups])
    address = lambda a: t.let(F.trim(decode_entities(part(a, 1, 2, 3))), lambda href: t.let(
        _resolved(href, F.col(base)), _without_dots))
    links = F.transform(found, lambda a: F.struct(
        address(a).alias("url"),
        F.nullif(t.squeeze(decode_entities(F.regexp_replace(part(a, 4), "<[^>]*>", " "))), F.lit("")).alias("link_text")))
    path = lambda u: F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    wanted = t.keep_first(F.filter(links, lambda x: F.lower(path(x["url"])).endswith(suffix)),
                          lambda x: x["url"])
    keep = [c for c in pages.columns if c not in (html, base)]
    rows = pages.select(*keep, F.posexplode(wanted).alias("pos", "a"))
    name = F.substring_index(path(F.col("a.url")), "/", -1)
    return rows.select(*keep, (F.col("pos") + 1).alias("link_no"), F.col("a.url").alias("url"),
                       name.alias("filename"), F.col("a.link_text").alias("link_text"),
                       F.lower(name).startswith("projet").alias("draft_suspected"))
