"""Quality rules as a short-circuit cascade, ordered by rejections per cost that a sample shows.

Native: built-in functions only, no Python on the rows.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
_BLANKS = " \t\n\x0b\f\r"

SAMPLE_ROWS = 2000                      # rows that costs and rejections are estimated on: about that many


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` holds; it may use `text` and the columns of `measure`."""
    name: str
    rejects: str


# Thresholds are shares of the words, characters or lines of the same document.
RULES = (
    Rule("too many symbols", "10 * n_symbols > n_words AND n_symbols > 3"),
    Rule("words too short or long", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", r"2 * regexp_count(text, '[\\p{Lu}]') > regexp_count(text, '[\\p{L}]')"),
    Rule("exclamations", r"2 * regexp_count(text, '[!?]{2}') > n_words"),
    Rule("few letters", r"2 * regexp_count(text, '[\\p{L}]') < word_chars"),
    Rule("few distinct words", "5 * n_distinct_words < n_words AND n_words < 1000 OR n_distinct_words < 10"),
)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, text, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct_words.

    Whole texts; a null text is an empty one, with zeros.  Columns other than `keep` and the text are dropped.
    Windows of three words are compared by a 64-bit hash of their words; windows are sorted with their places
    only in texts where one repeats.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    trimmed = F.trim(F.col("text"), F.lit(_BLANKS))
    words = base.select("*", F.when(trimmed == "", F.array().cast("array<string>"))
                        .otherwise(F.split(trimmed, SPACE + "+")).alias("__words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    counted = words.select("*", F.size("__words").cast("long").alias("n_words"), lines.alias("__lines"),
                           F.expr("""CASE WHEN size(__words) >= 3 THEN
                               transform(sequence(0, size(__words) - 3),
                                         i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)))
                               ELSE CAST(array() AS array<bigint>) END""").alias("__hashes"))
    sized = counted.select(
        *keep, "text", "n_words",
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct_words"),
        F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(
            F.transform("__hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__sorted"))
    places = F.expr("""sort_array(transform(
        filter(sequence(0, size(__sorted) - 1),
               k -> coalesce(get(__sorted, k).h = get(__sorted, k - 1).h, false)
                    OR coalesce(get(__sorted, k).h = get(__sorted, k + 1).h, false)),
        k -> get(__sorted, k).i))""")
    placed = sized.select("*", F.when(F.col("__sorted").isNotNull(), places).alias("__places"))
    covered = F.expr("""aggregate(__places, named_struct('last', -3, 'n', 0),
        (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)""")
    return placed.select(*[c for c in sized.columns if c != "__sorted"],
                         F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def estimate(measured: DataFrame, rules: tuple[Rule, ...]) -> tuple[list[dict[str, bool]], dict[str, float]]:
    """What every rule says of the rows of a bounded sample, and the seconds that it takes over them."""
    said = [{r.name: bool(row[i]) for i, r in enumerate(rules)} for row in
            measured.select(*[F.expr(r.rejects).alias(f"r{i}") for i, r in enumerate(rules)]).collect()]
    cost = {}
    for r in rules:
        took = []
        for _ in range(2):
            start = time.perf_counter()
            measured.select(F.count_if(F.expr(r.rejects))).first()
            took.append(time.perf_counter() - start)
        cost[r.name] = min(took)
    return said, cost


def order_by_yield(rules: tuple[Rule, ...], said: list[dict[str, bool]], cost: dict[str, float]) -> list[Rule]:
    """Next comes the rule with most rejections per cost among the sample rows that passed those before it."""
    left, rows, out = list(rules), said, []
    while left:
        best = max(left, key=lambda r: (sum(x[r.name] for x in rows) / max(cost[r.name], 1e-9), -rules.index(r)))
        out.append(best)
        left.remove(best)
        rows = [x for x in rows if not x[best.name]]
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", seed: int = 7) -> list[Rule]:
    """The rules in the order that a sample of about SAMPLE_ROWS documents suggests.

    The order decides what is computed, never what is kept.  An empty table leaves the order as given.
    """
    total = docs.count()
    if not total:
        return list(rules)
    part = docs.select(F.col(f"`{text_col}`").alias("text"), F.lit(0).alias("id"))
    part = part.sample(fraction=min(1.0, SAMPLE_ROWS / total), seed=seed)
    said, cost = estimate(cut_lineage(measure(part, keep=("id",))), rules)
    return order_by_yield(rules, said, cost)


def cascade(ordered: list[Rule]) -> Column:
    """True for rows that no rule rejects; a later rule is computed only where the earlier ones pass."""
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the measures, base_failed and kept for every row of `docs`.

    Null and empty texts have no words and so fail; repeated rows are judged one by one and alike; an empty
    table gives an empty result; columns other than `keep` and the text play no part.
    """
    ordered = plan(docs, rules, text_col)
    measured = measure(docs, text_col, keep).withColumn("base_failed", base_failed())
    return measured.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered)).alias("kept"))
