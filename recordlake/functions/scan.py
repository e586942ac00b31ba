"""Looks for patterns in whole batches of texts at once, with RE2 (pyarrow), before Java's patterns decide.

RE2 reads a text once whatever the pattern, which costs about a fiftieth of trying Java's alternatives at every character.
It has no look-around and other word characters, so a pattern is widened first: what RE2 does not find, Java's pattern does not
find either, and only what RE2 finds is given to Java's pattern.  Results are therefore those of Java's patterns.
"""
from __future__ import annotations

import re
from functools import lru_cache
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions import lexicons as lx

SPLIT = "\u0001"
SPACE = r"[\t-\r\x{85}\p{Z}]"        # white space as (?U)\s has it
UNTIDY = rf"{SPACE}{SPACE}|[\t-\r\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
ANY = "(?s:.)"
NOT_WORD = "[^0-9A-Za-z_]"      # no narrower than what stands before or after Java's word
CLASSES = {"CATEGORY_DIGIT": r"\p{Nd}", "CATEGORY_SPACE": r"\t-\r\x{85}\p{Z}", "CATEGORY_WORD": r"\p{L}\p{M}\p{N}\p{Pc}\p{So}\x{200c}\x{200d}"}


class _Wider(Exception):
    """The pattern has no exact counterpart."""


def _letter(code: int, inside: bool = False) -> str:
    if chr(code) in "iI":       # Java takes the Turkish letters for i as well
        found = "iI\\x{130}\\x{131}"
        return found if inside else f"[{found}]"
    return f"\\x{{{code:x}}}"


def _steps(steps, exact: bool) -> str:
    out, steps = [], list(steps)
    for at, (op, value) in enumerate(steps):
        name = str(op)
        if name == "LITERAL":
            out.append(_letter(value))
        elif name == "IN":
            out.append(_class(value, exact))
        elif name == "ANY":
            out.append(r"[^\n\r\x{85}\x{2028}\x{2029}]" if exact else ANY)
        elif name == "BRANCH":
            out.append("(?:" + "|".join(_steps(p, exact) for p in value[1]) + ")")
        elif name == "SUBPATTERN":
            if value[1] or value[2]:
                _only_wider(exact)
            out.append(f"(?:{_steps(value[3], exact)})")
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = value
            if name == "MIN_REPEAT":
                _only_wider(exact)
            most = "" if high is parser.MAXREPEAT else str(high)
            out.append(f"(?:{_steps(part, exact)}){{{low},{most}}}")
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            _only_wider(exact)
        else:
            raise LookupError(name)
    return "".join(out)


def _only_wider(exact: bool) -> None:
    if exact:
        raise _Wider


def _class(items, exact: bool) -> str:
    found = []
    for kind, item in items:
        name = str(kind)
        if name == "NEGATE" or name == "CATEGORY" and str(item) not in CLASSES:
            _only_wider(exact)
            return ANY
        if name == "LITERAL":
            found.append(_letter(item, True))
        elif name == "RANGE":
            _only_wider(exact)
            found.append(f"\\x{{{item[0]:x}}}-\\x{{{item[1]:x}}}iI\\x{{130}}\\x{{131}}")
        elif name == "CATEGORY":
            _only_wider(exact)
            found.append(CLASSES[str(item)])
        else:
            raise LookupError(name)
    return f"[{''.join(found)}]"


def _parsed(pattern: str):
    plain = re.sub(r"^\(\?[iuUs]+\)", "", pattern)
    return parser.parse(re.sub(r"\\p\{\w+\}", r"\\w", plain))


def _alternatives(parsed) -> list:
    """The top-level alternatives, each as a list of steps."""
    steps = list(parsed)
    if len(steps) == 1 and str(steps[0][0]) == "BRANCH":
        return [list(p) for p in steps[0][1][1]]
    return [steps]


def _edge(step) -> bool:
    return str(step[0]) == "AT" and str(step[1]) == "AT_BOUNDARY"


def _plain(step) -> bool:
    return str(step[0]) == "LITERAL" and chr(step[1]).isascii() and (chr(step[1]).isalnum() or chr(step[1]) == "_")


def _wide(steps: list) -> str:
    """An alternative widened; a word boundary at its ends still asks for what is no ASCII word character."""
    before = NOT_WORD if len(steps) > 1 and _edge(steps[0]) and _plain(steps[1]) else ""
    after = NOT_WORD if len(steps) > 1 and _edge(steps[-1]) and _plain(steps[-2]) else ""
    return (rf"(?:\A|{before})" if before else "") + _steps(steps, False) + (rf"(?:\z|{after})" if after else "")


@lru_cache(maxsize=None)
def wide(pattern: str) -> str | None:
    """An RE2 pattern that finds something in every text in which Java's (?iuU) pattern does; None where there is none."""
    try:
        found = "(?i)" + "|".join(_wide(a) for a in _alternatives(_parsed(pattern)))
        pc.match_substring_regex(pa.array([""]), found)
        return found
    except (re.error, LookupError, pa.ArrowInvalid):
        return None


@lru_cache(maxsize=None)
def counted(pattern: str) -> tuple[str | None, str | None] | None:
    """(exact, rest): where ``rest`` finds nothing, ``exact`` counts as Java's (?iuU) pattern does.  None: only Java can tell."""
    exact, rest = [], []
    try:
        for steps in _alternatives(_parsed(pattern)):
            try:
                exact.append(_steps(steps, True))
            except _Wider:
                rest.append(_wide(steps))
        out = tuple("(?i)" + "|".join(x) if x else None for x in (exact, rest))
        for x in out:
            if x is not None and pc.match_substring_regex(pa.array([""]), x)[0].as_py():
                return None     # may be empty
        return out
    except (re.error, LookupError, pa.ArrowInvalid):
        return None


def _matches(texts: pa.Array, pattern: str | None) -> np.ndarray:
    if pattern is None:
        return pc.is_valid(texts).to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _lists(values: pa.Array, parents: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of values by the number of their row; null where ``like`` is."""
    ends = np.cumsum(np.bincount(parents, minlength=len(like)))
    offsets = pa.array(np.r_[0, ends].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(like) if like.null_count else None)


def _squeezed(texts: pa.Array) -> pa.Array:
    """Runs of white space become one space, ends trimmed."""
    untidy = pc.match_substring_regex(texts, UNTIDY)
    if pc.any(untidy).as_py():
        texts = pc.replace_with_mask(texts, pc.fill_null(untidy, False), pc.replace_substring_regex(texts.filter(untidy), f"{SPACE}+", " "))
    return pc.utf8_trim(texts, " ")


def _split(texts: pa.Array) -> pa.Array:
    names = "|".join(lx.ABBREVIATIONS)
    short = rf"(^|[ {SPLIT}])((?i:{names})|\p{{Lu}})(\.+){SPLIT}"
    marked = pc.replace_substring_regex(_squeezed(texts), r"([.!?]) ([A-ZÀ-Ý«“\"])", rf"\1{SPLIT}\2")
    heal = pc.match_substring_regex(marked, short)
    if pc.any(heal).as_py():
        some = marked.filter(heal)
        for _ in range(2):      # a match takes the break before it, so of neighbours every second one waits for the next time
            some = pc.replace_substring_regex(some, short, r"\1\2\3 ")
        marked = pc.replace_with_mask(marked, pc.fill_null(heal, False), some)
    lists = pc.split_pattern(marked, SPLIT)
    flat, parents = pc.utf8_trim(lists.flatten(), " "), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return _lists(flat.filter(full), parents[full.to_numpy(zero_copy_only=False)], texts)


def sentences(c: Column) -> Column:
    """Array of sentences, as ``text.sentences`` has them."""
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return _split(texts)
    return split(c)


def squeeze(c: Column) -> Column:
    """Runs of any white space become one space; ends trimmed."""
    @F.arrow_udf("string")
    def squeezed(texts: pa.Array) -> pa.Array:
        return _squeezed(texts)
    return squeezed(c)


def marked(texts: Column, *patterns: str) -> Column:
    """Of an array of texts those in which a pattern may match: array of struct(s, at, m), with its place in the array from 0
    and bit i of m for the ith pattern."""
    wider = [wide(p) for p in patterns]
    some = None if None in wider else "|".join(f"(?:{p})" for p in wider)

    @F.arrow_udf("array<struct<s:string,at:int,m:int>>")
    def marks(lists: pa.Array) -> pa.Array:
        flat, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        hit = _matches(flat, some)
        at = np.arange(len(flat)) - np.searchsorted(parents, parents)
        flat, parents, at = flat.filter(pa.array(hit)), parents[hit], at[hit].astype(np.int32)
        bits = np.zeros(len(flat), np.int32)
        for i, p in enumerate(wider):
            bits |= (_matches(flat, p) if len(wider) > 1 else np.ones(len(flat), bool)).astype(np.int32) << i
        return _lists(pa.StructArray.from_arrays([flat, pa.array(at), pa.array(bits)], ["s", "at", "m"]), parents, lists)
    return marks(texts)


def has(marked_text: Column, i: int) -> Column:
    """Whether the ith pattern may match a text that ``marked`` gave."""
    return marked_text["m"].bitwiseAND(1 << i) != 0


def likely(texts: Column, pattern: str) -> Column:
    """Of an array of texts those in which the pattern may match."""
    return F.transform(marked(texts, pattern), lambda x: x["s"])


def may_match(c: Column, pattern: str) -> Column:
    """Whether the pattern may match a text."""
    wider = wide(pattern)

    @F.arrow_udf("boolean")
    def may(texts: pa.Array) -> pa.Array:
        return pc.is_valid(texts) if wider is None else pc.match_substring_regex(texts, wider)
    return may(c)


def counts(c: Column, patterns: list[str]) -> Column:
    """How many times each pattern occurs in a text; -1 where only Java's pattern can tell."""
    known = [counted(p) for p in patterns]

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        out = np.empty((len(texts), len(known)), np.int32)
        for i, pair in enumerate(known):
            exact, rest = pair or (None, None)
            n = pc.count_substring_regex(texts, exact) if exact else pa.array(np.zeros(len(texts), np.int32))
            ask = np.ones(len(texts), bool) if pair is None else _matches(texts, rest) if rest else np.zeros(len(texts), bool)
            out[:, i] = np.where(ask, -1, pc.fill_null(n, 0).to_numpy(zero_copy_only=False))
        flat = pa.array(out.reshape(-1))
        return _lists(flat, np.repeat(np.arange(len(texts)), len(known)), texts) if not texts.null_count else pa.array(
            [None if x is None else y.tolist() for x, y in zip(texts.to_pylist(), out)], pa.list_(pa.int32()))
    return found(c)


def from_first(c: Column, pattern: str) -> Column:
    """A text from the character before the first place at which the pattern may match; null where it matches nowhere."""
    wider = wide(pattern)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        if wider is None:
            return texts
        # lists of what stands before and after the first match; RE2 gives places of Latin-1 patterns only
        parts = pc.split_pattern_regex(texts, f"(?is).?(?:{wider[4:]})", max_splits=1)
        found = pc.fill_null(pc.greater(pc.list_value_length(parts), 1), False).to_pylist()
        before = pc.binary_length(pc.list_element(parts, 0)).to_pylist() if len(texts) and not texts.null_count else [
            x and len(x[0].encode()) for x in parts.to_pylist()]
        return pa.array([s[n:] if f else None for s, n, f in zip(texts.cast(pa.binary()).to_pylist(), before, found)], pa.binary()).cast(pa.string())
    return cut(c)
