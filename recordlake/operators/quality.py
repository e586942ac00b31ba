"""Checks on generated text against its source, and on tables against their rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions import text as t
from recordlake.functions.numbers import number_cores
from recordlake.operators.signals import stop_ratio


def numbers_preserved(source, output) -> Column:
    """QC1: the same multiset of digit strings."""
    return number_cores(source) == number_cores(output)


def placeholders_preserved(output, tokens) -> Column:
    """QC2: every placeholder exactly once."""
    o = t.col(output)
    return F.forall(tokens, lambda x: (F.length(o) - F.length(F.replace(o, x, F.lit("")))) == F.length(x))


def refs_preserved(source, output) -> Column:
    """QC2: legal references of the source still there, blanks ignored."""
    bare = F.replace(t.col(output), F.lit(" "), F.lit(""))
    refs = F.regexp_extract_all(t.col(source), F.lit(lx.LEGAL_REF_SHORT), 0)
    return F.forall(refs, lambda r: F.contains(bare, F.replace(r, F.lit(" "), F.lit(""))))


def length_plausible(source, output) -> Column:
    """QC3: between half and twice the source."""
    return (F.length(output) / F.greatest(F.length(source), F.lit(1))).between(0.5, 2.0)


def no_preamble(output) -> Column:
    return ~t.col(output).rlike("(?iu)" + lx.PREAMBLE)


def not_empty(output) -> Column:
    return F.trim(t.col(output)) != ""


def is_target_language(source, output, lang: str, stop: dict[str, list[str]] | None = None) -> Column:
    """QC4: more stop words of the target than of French, and hardly any French; long texts only."""
    stop = stop or lx.STOP_WORDS
    long = t.count_of(F.lower(t.col(source)), "[a-zà-ÿ]+") >= 8
    fr = stop_ratio(output, stop["fr"])
    return F.when(long, (stop_ratio(output, stop[lang]) > fr) & (fr < 0.12)).otherwise(F.lit(True))


def glossary_honoured(pairs: DataFrame, glossary: DataFrame, key: str, source: str, output: str
                      ) -> DataFrame:
    """QC5: each glossary term that stands in the source has an accepted word in the output.

    ``glossary`` (term, accepted) has a row for each accepted word; case does not count.  It is a list for people to keep, so it is gathered
    into one value; a text is lowered once and then looked through term by term.
    """
    terms = glossary.where("term <> '' AND accepted IS NOT NULL").groupBy(F.lower("term").alias("term")).agg(F.collect_set(F.lower("accepted")).alias("words"))
    listed = terms.agg(F.collect_list(F.struct("term", "words")).alias("_g")).scalar()

    def honoured(v):
        return F.forall(v["g"], lambda g: ~F.contains(v["source"], g["term"]) | F.exists(g["words"], lambda w: F.contains(v["output"], w)))
    both = F.struct(F.lower(t.col(source)).alias("source"), F.lower(t.col(output)).alias("output"), F.col("_g").alias("g"))
    return pairs.withColumn("_g", listed).withColumn("glossary_honoured", t.let(both, honoured)).drop("_g")


def important_figures(text) -> Column:
    """Figures of three digits or more, or with a decimal, as digit strings."""
    body = F.regexp_replace(t.col(text), lx.CITATION, " ")
    found = F.regexp_extract_all(body, F.lit(lx.NUMBER), 0)
    kept = F.filter(found, lambda n: (F.length(F.regexp_replace(n, r"\D", "")) >= 3) | n.rlike(r"\d[.,]\d"))
    return F.transform(kept, lambda n: F.regexp_replace(n, r"\D", ""))


def figures_in_source(source, output) -> Column:
    """QC6: every important figure of the output stands in the source."""
    return F.size(F.array_except(important_figures(output), number_cores(source))) == 0


def cited_pages(output) -> Column:
    groups = F.regexp_extract_all(t.col(output), F.lit(lx.CITATION), 0)
    return F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), 1))),
                       lambda n: n.try_cast("int"))


def pages_cited(output) -> Column:
    return F.size(cited_pages(output)) > 0


def pages_exist(output, page_count) -> Column:
    return F.forall(cited_pages(output), lambda p: p.between(1, t.col(page_count)))


def sections_present(output, headings: list[str]) -> Column:
    out = F.lit(True)
    for h in headings:
        out = out & t.col(output).contains(h)
    return out


def check_outputs(pairs: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """QC1-QC3, QC6 as columns of one pass over (source, output) pairs."""
    return pairs.withColumns({
        "numbers_preserved": numbers_preserved(source, output),
        "refs_preserved": refs_preserved(source, output),
        "length_plausible": length_plausible(source, output),
        "no_preamble": no_preamble(output), "not_empty": not_empty(output),
        "figures_in_source": figures_in_source(source, output)})


def fallback_merge(pairs: DataFrame, ok: Column, source: str, output: str, note: str) -> DataFrame:
    """QC7: the output where it passed, else the source with a note."""
    return pairs.withColumn("passed", ok).withColumn("text", F.when(F.col("passed"), F.col(output)).otherwise(
        F.concat(F.col(source), F.lit(" "), F.lit(note))))


def validate_rows(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """QC8: rows that break a rule, with the names of the rules; repeated keys are one of them.

    Only the keys that occur more than once meet the table again.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(
        *key, F.lit(True).alias("_dup"))
    broken = F.filter(F.array(
        *[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()],
        F.when(F.col("_dup"), F.lit("unique key"))), lambda x: x.isNotNull())
    return df.join(repeated, key, "left").withColumn("broken", broken).drop("_dup").where(F.size("broken") > 0)
