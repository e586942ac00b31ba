"""Signals in the text of items: votes, amounts, references, places, dates, names.

Each extractor works on an array of sentences (or a page's text) inside the row and returns an array
of structs that keep the sentence as evidence.  ``long`` turns such a column into rows.  Only
roll-ups across items shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import numbers as nb
from recordlake.functions import scan
from recordlake.functions import text as t
from recordlake.functions.text import uni

WORD = r"[\p{L}\p{N}_]"
END = rf"(?!{WORD})"


def with_sentences(items: DataFrame, text: str = "text") -> DataFrame:
    """One column of sentences feeds all extractors, so the text is split once."""
    return items.withColumn("sentences", t.settled(scan.sentences(F.col(text))))


def long(rows: DataFrame, key: str, signals: Column) -> DataFrame:
    """One row per signal: key, seq (from 1) and the fields of the signal.

    The signals are settled first: Spark puts a filter on what is exploded, which would work them out again.
    """
    return rows.select(key, t.settled(signals).alias("s")).select(key, F.posexplode("s").alias("pos", "s")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("seq"), "s.*")


def _flat(sentences: Column, fn) -> Column:
    return F.flatten(F.transform(sentences, fn))


def _where(*parts: tuple[Column, Column]) -> Column:
    """The arrays whose condition holds, one after the other; the others are not worked out."""
    return F.flatten(F.filter(F.array(*[F.when(c, a) for c, a in parts]), lambda a: a.isNotNull()))


def first_match(c, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """PF14: name of the first pattern that matches."""
    out = None
    for name, pattern in rules:
        hit = t.col(c).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if default is not None else out


# ---- votes ---------------------------------------------------------------------------------------

def votes(sentences: Column) -> Column:
    """SG1: what each vote sentence states: kind and counts."""
    return F.filter(F.transform(scan.marked(sentences, *VOTE_PARTS), vote), lambda v: v["kind"].isNotNull())


VOTE_PARTS = [lx.VOTE_GUARD, lx.VOTE_AGAINST, lx.VOTE_ABSTENTION, lx.VOTE_ABSTAINS, lx.VOTE_NO_PART, lx.VOTE_REJECTED,
              lx.VOTE_UNANIMOUS, lx.VOTE_MAJORITY, lx.VOTE_FOR]


def vote(marked: Column) -> Column:
    """What a sentence states, marked for ``VOTE_PARTS``; its kind is null where it is no vote."""
    s = marked["s"]

    def may(pattern):
        return scan.has(marked, VOTE_PARTS.index(pattern))

    def found(pattern):
        return may(pattern) & s.rlike(uni(pattern))

    def number(pattern, groups):
        return F.when(may(pattern), nb.sum_counts(s, uni(pattern), groups))

    def times(pattern):
        return F.when(may(pattern), F.nullif(t.count_of(s, uni(pattern)), F.lit(0)))
    contrary = (found(lx.VOTE_ABSTAINS) | found(lx.VOTE_ABSTENTION) | found(lx.VOTE_AGAINST) | found(lx.VOTE_NO_PART))
    kind = (F.when(~found(lx.VOTE_GUARD), F.lit(None)).when(found(lx.VOTE_REJECTED), "rejected")
            .when(found(lx.VOTE_UNANIMOUS), "unanimous")
            .when(found(lx.VOTE_MAJORITY) | found(lx.VOTE_FOR) | contrary, "majority"))
    return F.struct(kind.alias("kind"), number(lx.VOTE_FOR, 1).alias("for"), number(lx.VOTE_AGAINST, 2).alias("against"),
                    F.coalesce(number(lx.VOTE_ABSTENTION, 2), times(lx.VOTE_ABSTAINS)).alias("abstentions"),
                    times(lx.VOTE_NO_PART).alias("did_not_vote"), s.alias("sentence"))


def vote_result(kinds) -> Column:
    """AG1 inside an item: rejected, else majority (or a contrary count), else unanimous."""
    v = t.col(kinds)
    return (F.when(F.exists(v, lambda x: x["kind"] == "rejected"), "rejected")
            .when(F.exists(v, lambda x: (x["kind"] == "majority")
                           | F.coalesce(x["against"], x["abstentions"]).isNotNull()), "majority")
            .when(F.size(v) > 0, "unanimous"))


def vote_result_agg(kind: str, contrary: Column | None = None) -> Column:
    """AG1 as an aggregate over vote rows."""
    contrary = F.lit(False) if contrary is None else contrary
    return (F.when(F.bool_or(F.col(kind) == "rejected"), "rejected")
            .when(F.bool_or((F.col(kind) == "majority") | contrary), "majority")
            .when(F.count(kind) > 0, "unanimous"))


# ---- amounts, references, wording -----------------------------------------------------------------

def amounts(sentences: Column) -> Column:
    """SG4: euro amounts, then rates, sentence by sentence."""
    def of(s, pattern, kind):
        return F.transform(
            F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), 1).alias("n"),
                         F.regexp_extract_all(s, F.lit(pattern), 0).alias("raw")),
            lambda m: F.struct(F.lit(kind).alias("kind"), nb.parse_number(m["n"]).alias("value"),
                               F.trim(m["raw"]).alias("raw"), s.alias("sentence")))
    return _flat(scan.marked(sentences, lx.EURO, lx.PERCENT), lambda x: _where(
        (scan.has(x, 0), of(x["s"], uni(lx.EURO), "eur")), (scan.has(x, 1), of(x["s"], lx.PERCENT, "pct"))))


def legal_refs(sentences: Column, codes: list[tuple[str, str]] | None = None) -> Column:
    """SG5: articles with the code named nearby, acts and budget instructions; no repeats."""
    named = [(name, uni(p)) for name, p in (codes or lx.CODES)]

    def reference(kind, code, ref, key, s):
        return F.struct(kind.alias("kind"), code.alias("code"), ref.alias("ref"), key.alias("key"),
                        s.alias("sentence"))

    def articles(s):
        def one(m):
            near = F.concat(t.window_after(s, m["end"], lx.CODE_WINDOW_AFTER), F.lit(" "),
                            t.window_before(s, m["start"], lx.CODE_WINDOW_BEFORE))
            code = t.let(near, lambda w: first_match(w, named))
            ref = F.upper(F.translate(F.regexp_replace(
                F.regexp_extract(m["text"], uni(lx.ARTICLE), 1), r"(?U)\s+", ""), "‑", "-"))
            return t.let(F.struct(code.alias("c"), ref.alias("r")), lambda v: reference(
                F.lit("article"), v["c"], v["r"],
                F.concat(F.coalesce(v["c"], F.lit("?")), F.lit(" "), v["r"]), s))
        return F.transform(t.spans(s, uni(lx.ARTICLE)), one)

    def acts(s):
        pairs = F.arrays_zip(F.regexp_extract_all(s, F.lit(uni(lx.ACT)), 1).alias("k"),
                             F.regexp_extract_all(s, F.lit(uni(lx.ACT)), 2).alias("n"))
        return F.transform(pairs, lambda p: reference(
            F.lower(p["k"]), F.lit(None).cast("string"), p["n"],
            F.concat(F.lower(p["k"]), F.lit(" "), p["n"]), s))

    def instructions(s):
        found = F.regexp_extract_all(s, F.lit("(?U)" + lx.BUDGET_INSTRUCTION), 0)
        return F.transform(found, lambda m: t.let(
            F.regexp_replace(m, r"\s+", ""), lambda r: reference(
                F.lit("instruction"), F.lit(None).cast("string"), r,
                F.concat(F.lit("instruction "), r), s)))

    return F.array_distinct(_flat(scan.marked(sentences, lx.ARTICLE, lx.ACT, lx.BUDGET_INSTRUCTION), lambda x: _where(
        (scan.has(x, 0), articles(x["s"])), (scan.has(x, 1), acts(x["s"])), (scan.has(x, 2), instructions(x["s"])))))


def exceptions(sentences: Column, limit: int | None = None) -> Column:
    """SG6: exception wording, accounting categories left out; all of it unless a limit is given."""
    worded = F.filter(scan.likely(sentences, lx.EXCEPTION), lambda s: s.rlike(uni(lx.EXCEPTION)) & ~t.mostly_numbers(s))

    def markers(s):
        real = F.filter(t.spans(s, uni(lx.EXCEPTION)), lambda m: ~F.concat(
            t.window_before(s, m["start"], 24), m["text"]).rlike(uni(lx.ACCOUNTING_EXCEPTIONAL)))
        return F.transform(real, lambda m: F.struct(F.lower(m["text"]).alias("marker"),
                                                    s.alias("sentence")))
    return first_of(_flat(worded, markers), limit)


def first_of(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def rule_mentions(sentences: Column, pattern: str | None = None, limit: int | None = None) -> Column:
    """SG7: sentences that point at a rule in words."""
    found = F.filter(scan.likely(sentences, pattern or lx.RULE_WORDING), lambda s: s.rlike(uni(pattern or lx.RULE_WORDING))
                     & ~t.mostly_numbers(s))
    return F.transform(first_of(found, limit), lambda s: F.struct(s.alias("sentence")))


def followups(sentences: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """SG8: first matching of authorisation, deferred, planned; carry-overs and figures skipped."""
    rules = rules or lx.FOLLOWUPS

    def kind(x):
        out = F
        for i, (name, p) in enumerate(rules):
            out = out.when(scan.has(x, i) & x["s"].rlike(uni(p)), name)
        return out
    typed = F.transform(scan.marked(sentences, *[p for _, p in rules]), lambda x: F.struct(
        kind(x).alias("type"), x["s"].alias("sentence")))
    return F.filter(typed, lambda f: f["type"].isNotNull()
                    & ~f["sentence"].rlike(uni(lx.ACCOUNTING_CARRY)) & ~t.mostly_numbers(f["sentence"]))


# ---- topics and markers ----------------------------------------------------------------------------

def topic_hits(title: str, body: str, topics: list[tuple[str, str]] | None = None) -> Column:
    """SG9: array of struct(topic, hits, rank): the title counts three times; most hits first.

    The lexicon is a short list of patterns, so it is applied inside the row, each pattern once: to the title, three
    times over, and the text, kept apart by a character that no word has.  RE2 counts, and Java's pattern where RE2 cannot tell.
    """
    topics = topics or lx.TOPICS
    whole = F.concat_ws(t.SPLIT, *[F.coalesce(t.col(c), F.lit("")) for c in (title, title, title, body)])
    counts = scan.counts(whole, [p for _, p in topics])

    def hits(w, n, p):
        return F.when(n < 0, t.count_of(w, uni(p))).otherwise(n)
    scored = t.let(F.struct(whole.alias("w"), counts.alias("n")), lambda v: F.array(*[F.struct(
        (-hits(v["w"], v["n"][i], p)).alias("minus"), F.lit(i).alias("no"), F.lit(name).alias("topic")) for i, (name, p) in enumerate(topics)]))
    kept = F.array_sort(F.filter(scored, lambda x: x["minus"] < 0))
    return F.transform(kept, lambda x, i: F.struct(
        x["topic"].alias("topic"), (-x["minus"]).alias("hits"), (i + 1).alias("rank")))


def item_topics(title: str, body: str, topics=None, least: int = 3, most: int | None = None) -> Column:
    """The item's topics with three hits or more, best first."""
    ranked = F.filter(topic_hits(title, body, topics), lambda x: x["hits"] >= least)
    return F.transform(first_of(ranked, most), lambda x: x["topic"])


def is_sensitive(title: str, body: str, markers: str | None = None) -> Column:
    """SG10: one sale marker anywhere is enough."""
    pattern = markers or lx.SALE_MARKERS

    def found(c):
        return scan.may_match(t.col(c), pattern) & t.col(c).rlike(uni(pattern))
    return found(title) | found(body)


# ---- places and parcels --------------------------------------------------------------------------------

STREET, HAMLET = lx.STREET, lx.HAMLET


def _cut_at_stop(name: Column) -> Column:
    return t.let(F.split(name, r"\s+"), lambda ws: t.let(
        F.array_position(F.transform(ws, lambda w: F.lower(w).isin(lx.PLACE_STOP)
                                     | w.rlike(r"^(?i:n°?\d*|\d+)$")), F.lit(True)),
        lambda at: F.array_join(F.when(at > 0, F.slice(ws, F.lit(1), at.cast("int") - 1))
                                .otherwise(ws), " ")))


def places(body: str, home_postcode: str | None = None) -> Column:
    """SG11: array of struct(kind, label, number): street and hamlet mentions of this commune."""
    flat = scan.squeeze(t.col(body))

    def elsewhere(text, end):
        code = F.regexp_extract(t.window_after(text, end, 40),
                                rf"(?<!{WORD})(\d{{5}}){END}", 1)
        return (code != "") & (code != (home_postcode or ""))

    def of(text, pattern, group, kind):
        def one(m):
            name = F.regexp_extract(m["text"], pattern, group)
            return t.let(F.struct(
                name.alias("name"), _cut_at_stop(name).alias("cut"),
                (m["end"] - F.length(name)).alias("at")), lambda v: F.struct(
                    F.lit(kind).alias("kind"),
                    (F.concat(F.lower(F.regexp_extract(m["text"], pattern, 2)), F.lit(" "), v["cut"])
                     if kind == "street" else v["cut"]).alias("label"),
                    (F.nullif(F.trim(F.regexp_extract(m["text"], pattern, 1)), F.lit(""))
                     if kind == "street" else F.lit(None).cast("string")).alias("number"),
                    ((v["cut"] != "") & ~elsewhere(text, v["at"] + F.length(v["cut"])))
                    .alias("keep")))
        return F.filter(F.transform(t.spans(text, pattern), one), lambda p: p["keep"])

    def first(pattern, *how):       # what stands before the first place is not read again
        return t.let(scan.from_first(flat, pattern), lambda x: F.when(x.isNotNull(), of(x, *how)))

    # a null text has no array, a text without places an empty one
    found = F.when(t.col(body).isNotNull(), F.flatten(F.filter(F.array(
        first(STREET, "(?iu)" + t.ahead(STREET), 3, "street"), first(HAMLET, t.ahead(HAMLET), 1, "lieu-dit")), lambda a: a.isNotNull())))
    unique = t.keep_first(found, lambda p: F.lower(p["label"]))
    return F.transform(unique, lambda p: F.struct(p["kind"].alias("kind"), p["label"].alias("label"),
                                                  p["number"].alias("number")))


def parcels(text: str, ocr: Column) -> Column:
    """SG12: array of struct(section, number, form, context) on pages that name the cadastre."""
    def of(page, pattern, form):
        return F.transform(t.spans(page, pattern), lambda m: F.struct(
            F.regexp_extract(m["text"], pattern, 1).alias("section"),
            F.lpad(F.regexp_extract(m["text"], pattern, 2), 4, "0").alias("number"),
            F.lit(form).alias("form"), m["start"].alias("start"), m["end"].alias("end")))

    def stacked(page):
        def cells(m):
            lines = F.filter(F.transform(F.split(F.regexp_extract(m["text"], lx.PARCEL_STACK, 1), "\n"),
                                         lambda x: F.trim(x)), lambda x: x != "")
            return t.let(lines, lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(
                x.rlike("^[A-ZÆ]{1,2}$") & F.get(ls, i + 1).rlike(r"^0*\d{1,4}$"), F.struct(
                    x.alias("section"),
                    F.lpad(F.regexp_extract(F.get(ls, i + 1), r"^0*(\d{1,4})$", 1), 4, "0")
                    .alias("number"),
                    F.lit("table").alias("form"), m["start"].alias("start"), m["end"].alias("end")))),
                lambda c: c.isNotNull()))
        return F.flatten(F.transform(t.spans(page, lx.PARCEL_STACK), cells))

    everything = F.concat(of(t.col(text), lx.PARCEL_INLINE, "inline"),
                          of(t.col(text), lx.PARCEL_TABLE, "table"),
                          of(t.col(text), lx.PARCEL_BARE, "bare"), stacked(t.col(text)))
    readable = F.filter(everything, lambda p: ~p["section"].rlike("[ÆŒ]") | ocr)
    cleaned = F.transform(readable, lambda p: F.struct(
        F.translate(p["section"], "ÆŒ", "AO").alias("section"), p["number"].alias("number"),
        p["form"].alias("form"), p["start"].alias("start"), p["end"].alias("end")))
    unique = t.keep_first(cleaned, lambda p: F.struct(p["section"], p["number"]))
    shown = F.transform(unique, lambda p: F.struct(
        p["section"].alias("section"), p["number"].alias("number"), p["form"].alias("form"),
        t.squeeze(F.substr(t.col(text), F.greatest(p["start"] - 80, F.lit(0)) + 1,
                           p["end"] + 80 - F.greatest(p["start"] - 80, F.lit(0)))).alias("context")))
    guard = t.col(text).rlike("(?iu)cadastr") | t.col(text).contains("Superficie")
    return F.when(guard, shown).otherwise(F.array().cast(
        "array<struct<section:string,number:string,form:string,context:string>>"))


# ---- dates -----------------------------------------------------------------------------------------------

MONTH_WORDS = "|".join(lx.MONTHS)
SPOKEN_DATE, LONG_DATE, HEADER_DATE, FORMULA_DATE = lx.SPOKEN_DATE, lx.LONG_DATE, lx.HEADER_DATE, lx.FORMULA_DATE

SPOKEN = "(?iu)" + t.ahead(SPOKEN_DATE.removeprefix("(?iu)"))


def _month(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in lx.MONTHS.items() for x in p])
    return F.try_element_at(table, F.lower(word))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day)


def mentioned_dates(sentences: Column, meeting: Column) -> Column:
    """SG13: array of struct(mentioned, sentence): dates from the meeting to 400 days later."""
    def of(s):
        parts = F.arrays_zip(*[F.regexp_extract_all(s, F.lit(SPOKEN), g).alias(n)
                               for g, n in ((1, "d"), (2, "m"), (3, "y"))])

        def one(p):
            day = F.when(F.lower(p["d"]) == "1er", F.lit(1)).otherwise(p["d"].try_cast("int"))
            year = F.when(p["y"] == "", F.year(meeting)).otherwise(p["y"].try_cast("int"))
            iso = _iso(year, _month(p["m"]), day)
            return F.struct(iso.try_cast("date").alias("mentioned"), s.alias("sentence"))
        # A date before the meeting is the past, whether or not a year is named.
        return F.filter(F.transform(parts, one), lambda x: F.datediff(
            x["mentioned"], meeting).between(0, lx.DATE_HORIZON_DAYS))
    return _flat(scan.likely(sentences, lx.SPOKEN_DATE), of)


def document_date(text: str) -> Column:
    """SG14: struct(value, form): opening formula, else a long date, else the header's date."""
    c = t.col(text)

    def group(pattern, n):
        return F.regexp_extract(c, pattern, n)

    year, day = nb.compound_number_word(group(FORMULA_DATE, 1)), nb.compound_number_word(
        group(FORMULA_DATE, 2))
    year = F.when(F.lower(group(FORMULA_DATE, 1)) == "zéro", F.lit(None)).otherwise(year)
    formula = F.when((group(FORMULA_DATE, 0) != "") & year.isNotNull() & day.between(1, 31), F.struct(
        _iso(year + 2000, _month(group(FORMULA_DATE, 3)), day).alias("value"),
        F.lit("formula").alias("form")))
    spelled = F.when(group(LONG_DATE, 0) != "", F.struct(
        _iso(group(LONG_DATE, 3).try_cast("int"), _month(group(LONG_DATE, 2)),
             group(LONG_DATE, 1).try_cast("int")).alias("value"), F.lit("long").alias("form")))
    d, m = group(HEADER_DATE, 1).try_cast("int"), group(HEADER_DATE, 2).try_cast("int")
    header = F.when((group(HEADER_DATE, 0) != "") & d.between(1, 31) & m.between(1, 12), F.struct(
        _iso(group(HEADER_DATE, 3).try_cast("int"), m, d).alias("value"),
        F.lit("header").alias("form")))
    return F.coalesce(formula, spelled, header)


def date_documents(pages: DataFrame, text: str = "text", filename: str | None = None) -> DataFrame:
    """SG14: ``pages`` with value, source and status of their date.

    source: the form in the text, else 'filename' where a name gives a date, else null; status: 'tentative'
    for a date that is read off, 'missing' for none.
    """
    found = document_date(text)
    hint = F.lit(None).cast("string") if filename is None else F.date_format(date_hint(filename), "yyyy-MM-dd")
    rows = pages.withColumn("_found", found).withColumn("_hint", hint)
    value = F.coalesce(F.col("_found.value"), F.col("_hint"))
    source = F.when(F.col("_found.value").isNotNull(), F.col("_found.form")).when(F.col("_hint").isNotNull(), "filename")
    return (rows.withColumn("value", value).withColumn("source", source)
            .withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("tentative"))
            .drop("_found", "_hint"))


def date_hint(filename) -> Column:
    """SG15: a date guessed from the digits of a file name; NULL when they are no date."""
    stem = F.regexp_replace(F.regexp_replace(
        F.try_url_decode(t.col(filename)), r"\.[A-Za-z]+$", ""), r"\D", "")
    year_first = stem.rlike(r"^(19|20)\d{6}$")
    iso = (F.when(year_first, F.concat_ws("-", F.substring(stem, 1, 4), F.substring(stem, 5, 2),
                                          F.substring(stem, 7, 2)))
           .when(F.length(stem) == 8, F.concat_ws("-", F.substring(stem, 5, 4),
                                                  F.substring(stem, 3, 2), F.substring(stem, 1, 2)))
           .when(F.length(stem) == 6, F.concat(F.lit("20"), F.substring(stem, 5, 2), F.lit("-"),
                                               F.substring(stem, 3, 2), F.lit("-"),
                                               F.substring(stem, 1, 2))))
    return iso.try_cast("date")


# ---- people ------------------------------------------------------------------------------------------------

def surname(name: Column) -> Column:
    """The capitalised word of a name, else its last word, in title case."""
    upper = F.regexp_extract(name, r"([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’-]{2,})", 1)
    return F.initcap(F.lower(F.when(upper != "", upper).otherwise(F.substring_index(name, " ", -1))))


def chair(text: str) -> Column:
    """SG16: family name of the presiding officer, NULL when the opening phrase is missing."""
    found = F.regexp_extract(t.squeeze(text), "(?s)" + lx.CHAIR, 1)
    return F.when(found != "", surname(found))


def _names_in(block: Column) -> Column:
    """Names of a list with their role in it: the person named, or the holder of a proxy."""
    chunks = F.split(block, r"[,;\n]|\.(?=\s+[A-ZÀ-Ý])|(?<![\p{L}\p{N}_])et(?![\p{L}\p{N}_])")

    def of(chunk):
        parts = F.split(F.regexp_replace(chunk, r"^[ .]+|[ .]+$", ""), uni(lx.PROXY), 2)
        named = F.transform(parts, lambda p, i: F.struct(
            F.regexp_replace(p, r"^[ .:]+|[ .:]+$", "").alias("name"), (i > 0).alias("holder")))
        return F.filter(named, lambda n: (F.size(F.split(n["name"], " ")).between(2, 4))
                        & F.forall(F.split(n["name"], " "), lambda w: w.rlike(r"^\p{Lu}")))
    return F.flatten(F.transform(chunks, of))


def attendance(text: str) -> Column:
    """SG17: array of struct(role, name); roles are present, absent and proxy holder."""
    flat = t.squeeze(text)

    def of(pattern, role):
        blocks = F.regexp_extract_all(flat, F.lit("(?ius)" + pattern), 1)
        return F.transform(F.flatten(F.transform(blocks, _names_in)), lambda n: F.struct(
            F.when(n["holder"], F.lit("holder")).otherwise(role).alias("role"),
            n["name"].alias("name")))
    return F.concat(of(lx.PRESENT_LIST, "present"), of(lx.ABSENT_LIST, "absent"))


HONORIFIC_NAME = (rf"(?<!{WORD}){lx.HONORIFIC}[ \t]+({lx.NAME_WORD}(?:[ \t]+{lx.NAME_WORD}){{0,2}})")


def honorific_names(text: str) -> Column:
    """Names written after a title."""
    return F.regexp_extract_all(t.squeeze(text), F.lit(HONORIFIC_NAME), 1)


def private_names(text: str) -> Column:
    """SG18: array of struct(field, name): names in seller, buyer and owner fields.

    A list that ends in a comma or "et" goes on with the next line; organisations and pseudonyms
    are left out.
    """
    joined = F.regexp_replace(t.col(text), r"(?iu)(,|(?<![\p{L}\p{N}_])et)[ \t]*\n\s*", "$1 ")
    pattern = "(?iu)" + lx.PRIVATE_FIELD
    fields = F.arrays_zip(F.regexp_extract_all(joined, F.lit(pattern), 1).alias("field"),
                          F.regexp_extract_all(joined, F.lit(pattern), 2).alias("value"))

    def of(f):
        parts = F.split(f["value"], r"(?iu),|;|(?<![\p{L}\p{N}_])et(?![\p{L}\p{N}_])")
        names = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ .:\-\t]+|[ .:\-\t]+$", ""))
        good = F.filter(names, lambda n: ~n.rlike("^P-[0-9a-f]{10}$") & t.let(
            F.filter(F.split(t.fold(n), "[^0-9a-z]+"), lambda x: x != ""),
            lambda toks: (F.size(toks) >= 2) & ~F.exists(toks, lambda x: x.isin(lx.ORG_WORDS))))
        return F.transform(good, lambda n: F.struct(F.trim(f["field"]).alias("field"),
                                                    n.alias("name")))
    return F.flatten(F.transform(fields, of))


# ---- language -------------------------------------------------------------------------------------------------

LATIN_WORD = "[a-zà-ÿ’']+"


def _by_letter(words: list[str]) -> str:
    """The words as alternatives that share their first letters, so that one letter rules out most of them."""
    rest = {}
    for w in words:
        rest.setdefault(w[:1], []).append(w[1:])
    return "|".join(c if set(ws) <= {""} else f"{c}(?:{_by_letter(ws)})" for c, ws in sorted(rest.items(), reverse=True))


def _one_of(words: list[str], letter: str) -> str:
    """A pattern for a whole word of the list; where all are plain letters it looks at the next one before anything else."""
    if not words or not all(w.isalpha() for w in words):
        return rf"(?<!{letter})(?:{'|'.join(words)})(?!{letter})"
    return rf"(?=[{''.join(sorted({w[0] for w in words}))}])(?<!{letter})(?:{_by_letter(words)})(?!{letter})"


def stop_ratio(c, words: list[str]) -> Column:
    """Share of stop words among the words of a text.  Counted by pattern, no explode."""
    low = F.lower(t.col(c))
    total = t.count_of(low, LATIN_WORD)
    hits = t.count_of(low, _one_of(words, "[a-zà-ÿ’']"))
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def language(c, stop: dict[str, list[str]]) -> Column:
    """SG21: struct(lang, ratio): the language with the largest share of stop words."""
    scored = F.array(*[F.struct((-stop_ratio(c, words)).alias("minus"), F.lit(lang).alias("lang"))
                       for lang, words in sorted(stop.items())])
    best = F.array_min(scored)
    return F.struct(F.when(best["minus"] < 0, best["lang"]).alias("lang"),
                    (-best["minus"]).alias("ratio"))


def is_french(c) -> Column:
    """French prose: two function words and more than twice the others, or one and none of them."""
    low = F.lower(t.col(c))
    three = low.rlike(r"\p{L}\P{L}+\p{L}+\P{L}+\p{L}")

    def hits(words):
        return t.count_of(low, _one_of(words, r"\p{L}"))
    fr, other = hits(lx.FRENCH_FUNCTION_WORDS), hits(lx.OTHER_FUNCTION_WORDS)
    return three & (((fr >= 2) & (fr > 2 * other)) | ((fr >= 1) & (other == 0)))
