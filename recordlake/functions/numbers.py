"""Numbers written in text: parsing, number words, digit cores, euro formatting."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx
from recordlake.functions.text import col


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_number(c) -> Column:
    """French or mixed separators to a double: ``12 000,50``, ``3 522.01``, ``1.049.853,58``."""
    s = F.regexp_replace(col(c), "[\\s  ]", "")
    both = s.contains(",") & s.contains(".")
    plain = (F.when(both, F.translate(s, ",.", "."))
             .when(s.contains(","), F.translate(s, ",", "."))
             .when(s.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.translate(s, ".", ""))
             .otherwise(s))
    return plain.try_cast("double")


def number_word(c) -> Column:
    """Digits or a French number word to an integer; NULL when it is neither."""
    token = F.lower(col(c))
    return F.when(token.rlike(r"^\d+$"), token.try_cast("int")).otherwise(
        F.try_element_at(_lookup(lx.NUMBER_WORDS), token))


def compound_number_word(c) -> Column:
    """Day or year words with tens: ``vingt et un`` -> 21, ``dix-sept`` -> 17."""
    token = F.regexp_replace(F.lower(F.trim(col(c))), r"[\s-]+", " ")
    parts = F.split(F.regexp_replace(token, " et ", " "), " ")
    table = _lookup(lx.DATE_NUMBER_WORDS)
    values = F.transform(parts, lambda w: F.try_element_at(table, w))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + v)
    return F.when(token.rlike(r"^\d+$"), token.try_cast("int")).otherwise(total)


def number_cores(c) -> Column:
    """Sorted digit strings of every number, separators ignored."""
    found = F.regexp_extract_all(col(c), F.lit(lx.NUMBER), 0)
    return F.array_sort(F.transform(found, lambda n: F.regexp_replace(n, r"\D", "")))


def sum_counts(c, pattern: str, groups: int) -> Column:
    """Sum of the number (digits or word) captured by each match; NULL when zero."""
    total = F.lit(0)
    for g in range(1, groups + 1):
        found = F.regexp_extract_all(col(c), F.lit(pattern), g)
        numbers = F.transform(found, lambda x: F.coalesce(number_word(x), F.lit(0)))
        total = total + F.aggregate(numbers, F.lit(0), lambda acc, v: acc + v)
    return F.nullif(total, F.lit(0))


def money_list(amounts: Column, limit: int | None = None, lang: str = "fr") -> Column:
    """SG26: amounts as text, one after the other; beyond a limit only how many more there are."""
    shown = amounts if limit is None else F.slice(amounts, 1, limit)
    text = F.array_join(F.transform(shown, lambda x: format_euros(x, lang)), ", ")
    if limit is None:
        return text
    more = F.size(amounts) - limit
    return F.when(more > 0, F.concat(text, F.lit(" +"), more.cast("string"))).otherwise(text)


def format_euros(c, lang: str = "fr") -> Column:
    """Whole euros in the reader's convention."""
    text = F.format_number(col(c), 0)
    return F.when(F.lit(lang == "en"), F.concat(F.lit("€"), text)).otherwise(
        F.concat(F.translate(text, ",", " "), F.lit(" €")))
