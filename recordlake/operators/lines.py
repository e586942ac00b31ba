"""Lines, blocks and items of a document.

A document is one row, so its structure is worked out inside the row: arrays of lines and a string
with one letter per line.  Runs such as "a heading wrapped onto the next line" are regular
expressions over that string.  Nothing is exploded or shuffled until the caller asks for long rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.session import cut_lineage

CUT, FIELD = "\u0001", "\u0002"


def page_lines(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """PF1: one row per clean line, numbered from 1."""
    keep = [c for c in pages.columns if c != text]
    return (pages.select(*keep, F.posexplode(t.clean_lines(text, page)).alias("pos", "line"))
            .withColumn("line_no", F.col("pos") + 1).drop("pos"))


def record_lines(pages: Column) -> Column:
    """Lines of all pages of a record: array of struct(line, page)."""
    return F.flatten(F.transform(pages, lambda p: F.transform(
        t.clean_lines(p["text"], p["page"]),
        lambda s: F.struct(s.alias("line"), p["page"].cast("int").alias("page")))))


def _letter(line: Column) -> Column:
    """h/x heading, t table row, b/y bullet, p/w paragraph, _ blank; x y w are short capital lines."""
    caps = t.is_caps_words(line)
    return (F.when(line == "", "_")
            .when(t.is_heading(line), F.when(caps, "x").otherwise("h"))
            .when(t.is_table_line(line), "t")
            .when(line.rlike(lx.BULLET), F.when(caps, "y").otherwise("b"))
            .otherwise(F.when(caps, "w").otherwise("p")))


def block_array(lines: Column) -> Column:
    """PF4: array of struct(kind, text, page) from an array of struct(line, page)."""
    described = F.transform(lines, lambda r: F.struct(
        r["line"].alias("line"), r["page"].alias("page"),
        t.is_title_like(r["line"]).alias("title"),
        r["line"].rlike(r"^\p{Lu}").alias("upper"),
        (r["line"].rlike(lx.SENTENCE_END) & (F.length(r["line"]) < 70)).alias("closed"),
        _letter(r["line"]).alias("k")))
    return _assemble(described)


def _assemble(rows: Column) -> Column:
    return t.let(rows, lambda r: t.let(
        F.split(_settled_letters(r), "(?!^)"), lambda k: t.let(
            F.split(_starts(r, k), "(?!^)"), lambda s: _blocks(r, s))))


def _settled_letters(rows: Column) -> Column:
    letters = F.array_join(F.transform(rows, lambda r: r["k"]), "")
    # Capital lines right after a heading belong to it; then what is left of x, w, y is plain h, p, b.
    merged = F.regexp_replace(letters, r"(?<=[hx])[xyw]|(?<!^)\G[xyw]", "m")
    plain = F.translate(merged, "xwy", "hpb")
    # A table row continues the table above it, also across blank lines.
    return F.regexp_replace(plain, "(?<=t)(_*)t", "$1u")


def _starts(rows: Column, letters: Column) -> Column:
    def para(r, i):
        before = F.get(rows, i - 1)
        return (F.when((i == 0) | (F.get(letters, i - 1) != "p"), "p")
                .when(before["closed"] & r["upper"], "P")
                .when(before["title"] & r["upper"], "C").otherwise("p"))

    marked = F.array_join(F.transform(
        rows, lambda r, i: F.when(F.get(letters, i) == "p", para(r, i))
        .otherwise(F.get(letters, i))), "")
    # A chained line starts a block only when the line before it does.
    return F.regexp_replace(marked, r"(?<![pPC])[pPC]|P|(?<!^)\GC", "S")


def _blocks(rows: Column, starts: Column) -> Column:
    def piece(r, i):
        k, nxt = F.get(starts, i), F.get(starts, i + 1)
        heads_next = r["title"] & ((nxt == "b")
                                   | (nxt.isin("S", "p", "C") & F.get(rows, i + 1)["upper"]))
        kind = (F.when(k == "S", F.when(F.coalesce(heads_next, F.lit(False)), "subheading")
                       .otherwise("paragraph"))
                .when(k == "h", "heading").when(k == "t", "table").when(k == "b", "bullet"))
        body = F.when(k == "b", F.regexp_replace(r["line"], lx.BULLET, "")).otherwise(r["line"])
        opened = F.concat(F.lit(CUT), kind, F.lit(FIELD), r["page"].cast("string"), F.lit(FIELD), body)
        return (F.when(k.isin("S", "h", "t", "b"), opened)
                .when(k == "u", F.concat(F.lit("\n"), body))
                .when(k == "_", F.lit("")).otherwise(F.concat(F.lit(" "), body)))

    joined = F.array_join(F.transform(rows, piece), "")
    parts = F.filter(F.split(joined, CUT), lambda p: p != "")
    fields = F.transform(parts, lambda p: F.split(p, FIELD))
    return F.transform(fields, lambda p: F.struct(
        F.get(p, F.lit(0)).alias("kind"), F.get(p, F.lit(2)).alias("text"),
        F.get(p, F.lit(1)).cast("int").alias("page")))


def with_blocks(docs: DataFrame, pages: Column, name: str = "blocks") -> DataFrame:
    """Adds the block array.  Each step is a column of its own so it is evaluated once."""
    return (docs.withColumn("_lines", record_lines(pages))
            .withColumn(name, block_array(F.col("_lines"))).drop("_lines"))


def single_page(text: str = "text") -> Column:
    """A document of one page as a page array."""
    return F.array(F.struct(F.lit(1).alias("page"), F.col(text).alias("text")))


def _sections(blocks: Column) -> Column:
    """For each heading after the first: where it is, where the next is, whether it opens an item."""
    at = F.filter(F.transform(blocks, lambda b, i: F.when(b["kind"] == "heading", i)),
                  lambda i: i.isNotNull())

    def section(start, n, heads):
        end = F.coalesce(F.get(heads, n + 2), F.size(blocks))
        return F.struct(start.alias("from"), end.alias("to"))

    ranges = t.let(at, lambda heads: F.transform(
        F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))),
        lambda s, n: section(s, n, heads)))

    def full(s):
        body = F.slice(blocks, s["from"] + 2, F.greatest(s["to"] - s["from"] - 1, F.lit(0)))
        return t.let(body, lambda bs: (
            F.aggregate(F.filter(bs, lambda b: b["kind"].isin("paragraph", "bullet")), F.lit(0),
                        lambda a, b: a + t.chars(b["text"], "a-zà-ÿ")) >= 40)
            & F.exists(bs, lambda b: (b["kind"] == "paragraph")
                       & (t.count_of(b["text"], r"\S+") >= 8)))

    return F.filter(F.transform(ranges, lambda s, n: F.struct(
        s["from"].alias("from"), ((n == 0) | full(s)).alias("opens"))), lambda s: s["opens"])


def item_array(blocks: Column) -> Column:
    """PF5: array of struct(title_raw, page, blocks).

    The first heading is the document's title and what follows it the header.  Later headings open
    an item, except that one with hardly any prose below it is folded into the item before.
    """
    def build(bs, opening):
        return F.transform(opening, lambda s, n: F.struct(
            F.get(bs, s["from"])["text"].alias("title_raw"),
            F.get(bs, s["from"])["page"].alias("page"),
            F.transform(
                F.slice(bs, s["from"] + 2,
                        F.coalesce(F.get(opening, n + 1)["from"], F.size(bs)) - s["from"] - 1),
                lambda b: F.struct(F.when(b["kind"] == "heading", "subheading")
                                   .otherwise(b["kind"]).alias("kind"),
                                   b["text"].alias("text"), b["page"].alias("page")))
            .alias("blocks")))
    return t.let(blocks, lambda bs: t.let(_sections(bs), lambda o: build(bs, o)))


def items(docs: DataFrame, blocks: str = "blocks") -> DataFrame:
    """PF5/WN12: one row per item with its number, title, first and last page and body text."""
    keep = [c for c in docs.columns if c != blocks]
    long = docs.select(*keep, F.posexplode(item_array(F.col(blocks))).alias("pos", "item"))
    pages = F.concat(F.array(F.col("item.page")), F.col("item.blocks.page"))
    return long.select(
        *keep, (F.col("pos") + 1).alias("item_no"), F.col("item.title_raw").alias("title_raw"),
        F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"),
        F.array_join(F.col("item.blocks.text"), "\n").alias("body"),
        F.col("item.blocks").alias("blocks"))


def _leading_table(blocks: Column) -> Column:
    """How many blocks at the start are table rows, sub-headings or short row labels."""
    flags = F.array_join(F.transform(blocks, lambda b: F.when(
        b["kind"].isin("table", "subheading")
        | ((b["kind"] == "paragraph") & (F.size(t.words(b["text"])) < 8)), "t").otherwise("n")), "")
    return F.length(F.regexp_extract(flags, "^(t*)", 1))


def reattach_captions(item_rows: DataFrame, doc: str = "doc_id", agenda: str = "agenda_keys"
                      ) -> DataFrame:
    """PF6: a table caption caught mid-sentence goes to the item it is about.

    An item whose title is not on the agenda, that opens straight into a table and is followed by
    prose cut from the previous item, is taken apart: its table joins the best of the last three
    items by shared title words (the nearest on a tie) and its prose goes back to the item before.
    ``item_rows`` holds doc, item_no, title_raw, blocks and the agenda keys of the document; the
    answer is one row per kept item with its blocks.  Items of one document are bounded by the
    document, and the join partners are the three rows before, never the whole document.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(doc).orderBy("item_no")
    table_end = _leading_table(F.col("blocks"))
    rest = F.slice("blocks", table_end + 1, F.greatest(F.size("blocks") - table_end, F.lit(0)))
    key = t.title_key("title_raw")
    prev_paras = F.filter(F.col("prev_blocks"), lambda b: b["kind"] == "paragraph")
    unfinished = (F.size(prev_paras) > 0) & ~F.element_at(
        F.when(F.size(prev_paras) > 0, prev_paras), -1)["text"].rlike(r"[.!?:;»)\]]\s*$")
    first = F.get(rest, F.lit(0))
    on_agenda = F.exists(agenda, lambda a: (a == key) | F.startswith(a, key) | F.startswith(key, a))
    flagged = (item_rows.withColumn("prev_blocks", F.lag("blocks").over(w))
               .withColumn("caption", F.coalesce(
                   (F.size(agenda) > 0) & (F.get("blocks", F.lit(0))["kind"] == "table")
                   & (first["kind"] == "paragraph") & first["text"].rlike(r"^\p{Ll}")
                   & (F.size(t.words(first["text"])) >= 8)
                   & (first["page"] != F.col("first_page"))
                   & (key != "") & ~on_agenda & unfinished, F.lit(False)))
               .withColumn("table_part", F.when(F.col("caption"), F.concat(
                   F.array(F.struct(F.lit("subheading").alias("kind"),
                                    F.col("title_raw").alias("text"),
                                    F.col("first_page").alias("page"))),
                   F.slice("blocks", F.lit(1), table_end))))
               .withColumn("prose_part", F.when(F.col("caption"), rest))
               .drop("prev_blocks")
               .withColumn("n_kept", F.count_if(~F.col("caption")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    flagged = cut_lineage(flagged)      # read five times below: blocks are worked out once
    kept = flagged.where(~F.col("caption")).drop("caption", "table_part", "prose_part")
    captions = flagged.where("caption").select(
        F.col(doc).alias("_d"), F.col("item_no").alias("c_no"), key.alias("c_key"),
        "table_part", "prose_part", "n_kept")
    text = F.concat_ws(" ", t.title_key("title_raw"), t.title_key(
        F.array_join(F.col("blocks.text"), "\n")))
    # Candidate owners: the last three kept items before the caption, by the number of kept ones up to it.
    near = (captions.withColumn("n_kept", F.explode(F.array(F.col("n_kept"), F.col("n_kept") - 1, F.col("n_kept") - 2)))
            .join(kept.withColumnRenamed("n_kept", "_k"), (F.col("_d") == F.col(doc)) & (F.col("n_kept") == F.col("_k")))
            .select("_d", "c_no", "c_key", "table_part", "prose_part", "item_no", "title_raw", "blocks")
            .withColumn("hits", F.size(F.array_intersect(F.split("c_key", " "), F.split(text, " ")))))
    owners = near.groupBy("_d", "c_no").agg(
        F.max_by("item_no", F.struct("hits", "item_no")).alias("owner"),
        F.max("item_no").alias("previous"),
        F.first("table_part").alias("table_part"), F.first("prose_part").alias("prose_part"))
    extra = (owners.select("_d", F.col("owner").alias("_n"), "c_no", F.lit(0).alias("part"),
                           F.col("table_part").alias("more"))
             .unionByName(owners.select("_d", F.col("previous").alias("_n"), "c_no",
                                        F.lit(1).alias("part"), F.col("prose_part").alias("more"))))
    added = extra.groupBy("_d", "_n").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("c_no", "part", "more"))),
        lambda x: x["more"])).alias("_more"))
    return (kept.join(added, (F.col(doc) == F.col("_d")) & (F.col("item_no") == F.col("_n")), "left")
            .withColumn("blocks", F.concat("blocks", F.coalesce("_more", F.array().cast(
                kept.schema["blocks"].dataType))))
            .drop("_d", "_n", "_more", "n_kept"))
