"""Periodic runs of words, found from Lyndon roots, and texts with each run collapsed to its first period.

A run's words are all covered by sequences of words that occur twice in the document, so only stretches covered like
that are looked at; nothing else can hold a run.  Stretches of many documents are laid end to end with a smallest
symbol between them.  Baier's grouping (the first phase of his suffix sorter) takes groups of positions from the
highest to the lowest and lengthens the context of the nearest lower position before each member; the context that a
position has when its group's turn comes is the longest Lyndon word that begins there.  This is done under an order
of the words and under its reverse.  Every run has such a word as its root under one of them, and a root extends to
its run by the longest common extensions of two positions a period apart, in both directions.

Documents never leave their task; nothing is shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12                      # words in a run, at least
SLICE_WORDS = 300_000           # words looked at together; a longer document is a slice
_MIX = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]        # start, length, period


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word as a number (equal words, and only those, have the same one), and where each document begins."""
    number = dict.fromkeys(chain.from_iterable(words))
    number = dict(zip(number, range(len(number))))
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    return np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, bounds[-1]), bounds


def _scattered(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(1)
    x = (x ^ x >> np.uint64(31)) * _MIX
    return (x ^ x >> np.uint64(29)) * _MIX


def stretches(text: np.ndarray, bounds: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spans outside of which no document has a run of `least` words or more.

    A run of period q and length at least max(least, 2 q) is the union of two places, q words apart, of one sequence
    of max(least - q, q) words or more, hence of least / 2 rounded up.  Sequences are compared by a hash within their document, and a
    collision only makes a span longer.
    """
    width = max(1, (least + 1) // 2)
    n = len(text)
    starts = bounds[:-1]
    if n < width:
        return []
    doc = np.repeat(np.arange(len(starts)), np.diff(bounds))
    word = _scattered(text)
    grams = _scattered(doc[:n - width + 1])
    for i in range(width):
        grams = (grams ^ word[i:n - width + 1 + i]) * _MIX
        grams ^= grams >> np.uint64(32)
    inside = doc[:n - width + 1] == doc[width - 1:]
    at = np.flatnonzero(inside)
    found = grams[at]
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin = at[twice]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + width, -1)
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = bounds[np.searchsorted(bounds, a, "right"):np.searchsorted(bounds, b, "left")].tolist()
        out += [(x, y) for x, y in zip([a, *cuts], [*cuts, b]) if y - x >= least]
    return out


def lyndon_lengths(text: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that begins at each position, by Baier's grouping.

    Symbol 0 ends a stretch: it is smaller than all others, stands first in `text`, and no word reaches over it.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    members: list[list[int]] = [part.tolist() for part in np.split(order, cuts)]
    count = len(members)
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(np.arange(count), np.diff(np.concatenate([[0], cuts, [n]])))
    group = group.tolist()                      # group 0 holds the symbol 0 and is never taken
    lower = list(range(-1, count - 1))          # neighbours in the order of the groups
    upper = list(range(1, count + 1))
    size = [1] * count                          # of a group's context
    free = list(range(n))                       # leads to the nearest position to the left that was not taken yet
    lengths = [0] * n
    g = count - 1
    while g > 0:
        step = size[g]
        taken = [i for i in members[g] if group[i] == g]
        members[g] = []
        for i in taken:
            free[i] = i - 1
            lengths[i] = step
        before = []
        for i in taken:
            j = free[i]
            while free[j] != j:
                free[j] = j = free[free[j]]
            free[i] = j
            if group[j]:
                before.append(j)
        if len(before) == 1:
            moved = [((1, group[before[0]]), before)]
        else:
            times: dict[int, int] = {}
            for j in before:
                times[j] = times.get(j, 0) + 1
            parts: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                parts.setdefault((k, group[j]), []).append(j)
            moved = sorted(parts.items(), key=lambda p: -p[0][0])
        for (k, old), places in moved:
            new = len(members)
            members.append(places)
            size.append(size[old] + k * step)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            lower[above] = new
            for j in places:
                group[j] = new
        g = lower[g]
    return np.array(lengths, dtype=np.int64)


class Extensions:
    """Longest common extensions of two positions, from names of all blocks whose length is a power of two."""

    def __init__(self, text: np.ndarray, longest: int):
        n = len(text)
        ends = text == 0
        level = text.astype(np.int64).copy()
        level[ends] = level.max(initial=0) + 1 + np.arange(ends.sum())       # no two ends are equal
        self.levels = [level]
        width = 1
        while 2 * width <= longest:
            name = -1 - np.arange(n, dtype=np.int64)                        # blocks over the edge equal no other
            whole = n - 2 * width + 1
            if whole > 0:
                base = int(level.max()) + 1
                pair = level[:whole] * base + level[width:width + whole]
                name[:whole] = np.unique(pair, return_inverse=True)[1]
                # a left or right part over the edge has a negative name; whole blocks have none
            level = name
            self.levels.append(level)
            width *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j > i on."""
        out, n = np.zeros(len(i), dtype=np.int64), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            fits = b + (1 << k) <= n
            same = fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])
            out[same] += 1 << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j > i."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            fits = a >= 0
            same = fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])
            out[same] += 1 << k
        return out


def runs(text: np.ndarray, longest: int, least: int) -> Runs:
    """All runs between the symbols 0 of `text` (it begins and ends with one), by start, then period."""
    extend = Extensions(text, longest)
    turned = np.where(text > 0, text.max() + 1 - text, 0)
    found = []
    for order in (text, turned):
        period = lyndon_lengths(order)
        i = np.flatnonzero(period)
        p = period[i]
        left, right = extend.left(i, i + p), extend.right(i, i + p)
        length = left + p + right
        good = length >= np.maximum(least, 2 * p)
        found.append(np.stack([i[good] - left[good], p[good], length[good]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[:, 0], every[:, 2], every[:, 1]


def find(text: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> Runs:
    """Start, length and period of all runs of documents laid end to end, starts counted over all of them."""
    spans = stretches(text, bounds, least)
    if not spans:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    sizes = np.array([b - a for a, b in spans])
    joined = np.zeros(sizes.sum() + len(spans) + 1, dtype=np.int64)
    origin = np.zeros(len(joined), dtype=np.int64)
    at = 1
    for a, b in spans:
        joined[at:at + b - a] = text[a:b] + 1
        origin[at:at + b - a] = np.arange(a, b)
        at += b - a + 1
    _, dense = np.unique(joined, return_inverse=True)
    start, length, period = runs(dense, int(sizes.max()), least)
    return origin[start], length, period


def _slices(column: pa.Array) -> Iterator[list[list[bytes]]]:
    docs, size = [], 0
    for raw in column:
        docs.append((raw.as_py() or b"").split())
        size += len(docs[-1])
        if size >= SLICE_WORDS:
            yield docs
            docs, size = [], 0
    if docs:
        yield docs


_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapse(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words long, runs array<struct<start, length, period>>, collapsed string.

    Words are what stands between ASCII blanks, numbered from 0.  A run is a stretch with smallest period q, of
    max(least, 2 q) words or more, that neither neighbour extends; runs come by start, then period.  `collapsed` is the words, joined
    by one space, without those that any run holds after its first q words.  Null and empty texts have no
    words, no runs and an empty `collapsed`; a row for each row, repeated ones and null ids too; other columns are
    not read; an empty table gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for words in _slices(batch.column(1)):
                text, bounds = numbered(words)
                start, length, period = find(text, bounds, least)
                drop = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                kept = np.cumsum(drop[:-1]) == 0
                doc = np.searchsorted(bounds, start, "right") - 1           # of documents that begin there, the one with words
                offsets = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
                some = np.diff(offsets) > 0
                texts = [b" ".join(compress(w, kept[a:b].tolist()) if s else w)
                         for w, s, a, b in zip(words, some.tolist(), bounds.tolist(), bounds[1:].tolist())]
                items = pa.StructArray.from_arrays([pa.array(start - bounds[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(words)), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(texts, pa.binary())], [id_col, "n_words", "runs", "collapsed"])
                row += len(words)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, runs array<{_RUN}>, collapsed binary"
    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
