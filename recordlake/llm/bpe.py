"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct words of a block of the texts it reads and lays their bytes end to end.  An inverted
index leads from a token pair to the positions where it stands, in all words at once; merges are applied in the order
of their rank, wherever the pair stands, and only the neighbours of what was merged enter the index anew.  A word that
was spelled once is looked up from then on.  Texts never leave their task, so nothing is shuffled, and a lost task
starts over from its input.
"""
from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

MEMORY_WORDS = 300_000          # words a worker remembers, twice at most
BLOCK_BYTES = 1 << 20           # bytes of distinct words that are replayed together; one longer word is a block
SLICE_CHARS = 1 << 21           # characters split into words at a time
_SHIFT = 24                     # a pair is one number, left token << _SHIFT | right token
_EDGE = (1 << _SHIFT) - 1       # stands beside the first and the last token of a word; no pair has it


class Ranks:
    """The vocabulary of a rank file: tokens, single bytes and the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing or max(self.ranks.values()) >= _EDGE:
            raise ValueError(f"a rank file needs every byte and ranks below {_EDGE}; without: {missing}")
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.merges: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << _SHIFT | right] = rank
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that has the ids of at least these words, each as little-endian 32-bit numbers."""
        if len(self.new) > MEMORY_WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown = []
        for word in words:
            if word not in new:
                if word in old:
                    new[word] = old[word]
                else:
                    unknown.append(word)
        block, size = [], 0
        for word in unknown:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                new[word] = whole.to_bytes(4, "little")
                continue
            if block and size + len(raw) > BLOCK_BYTES:
                new.update(zip([w for w, _ in block], replay([b for _, b in block], self)))
                block, size = [], 0
            block.append((word, raw))
            size += len(raw)
        if block:
            new.update(zip([w for w, _ in block], replay([b for _, b in block], self)))
        return new


def replay(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each (non-empty) word, by merges in rank order over all words at once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    n = int(ends[-1])
    start = ranks.bytes[np.frombuffer(b"".join(words), np.uint8)]
    tokens = array("i", np.append(start, _EDGE).astype(np.int32).tobytes())
    after = np.arange(1, n + 2, dtype=np.int32)
    after[ends - 1] = n                                     # position n stands beside every edge
    before = np.arange(-1, n, dtype=np.int32)
    before[ends - size] = n
    after, before = array("i", after.tobytes()), array("i", np.append(before, n).astype(np.int32).tobytes())
    word_ends = ends.tolist()
    merges, get = ranks.merges, ranks.merges.get

    # the inverted index: rank of a pair -> positions of its left token
    inside = np.ones(n, dtype=bool)
    inside[ends - 1] = False
    at = np.flatnonzero(inside)
    pairs = start[at].astype(np.int64) << _SHIFT | start[at + 1]
    kinds, kind = np.unique(pairs, return_inverse=True)
    rank = np.array([merges.get(p, -1) for p in kinds.tolist()], dtype=np.int64)[kind] if len(at) else at
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0):]
    index: dict[int, list[int]] = {}
    if len(order):
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        for part in np.split(order, cuts):
            index[int(rank[part[0]])] = at[part].tolist()
    heap = list(index)
    heapify(heap)
    while heap:
        r = heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()                                       # equal pairs that overlap merge from the left
        wait, waiting = -1, []
        for i in places:
            if i < wait:
                waiting.append(i)
                continue
            j = after[i]
            if get(tokens[i] << _SHIFT | tokens[j]) != r:   # a token of it has gone since
                continue
            k, h = after[j], before[i]
            tokens[i], tokens[j] = r, -1
            after[i] = k
            before[k] = i
            least = r
            made = get(r << _SHIFT | tokens[k])
            if made is not None:
                if made in index:
                    index[made].append(i)
                else:
                    index[made] = [i]
                    heappush(heap, made)
                least = made
            made = get(tokens[h] << _SHIFT | r)
            if made is not None:
                if made in index:
                    index[made].append(h)
                else:
                    index[made] = [h]
                    heappush(heap, made)
                least = min(least, made)
            if least < r:                                   # a pair of lower rank comes first in this word
                wait = word_ends[bisect_right(word_ends, i)]
        if waiting:
            index[r] = waiting
            heappush(heap, r)
    left = np.frombuffer(tokens, np.int32)[:n]
    alive = left >= 0
    upto = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
    raw = left[alive].astype("<u4").tobytes()
    bounds = upto.tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def words(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The pattern's matches, in lists from about SLICE_CHARS characters each."""
    if len(text) <= SLICE_CHARS:
        yield pattern.findall(text)
        return
    at, width = 0, SLICE_CHARS
    while at < len(text):
        end = min(len(text), at + width)
        found = [m.span() for m in pattern.finditer(text, at, end)]
        if end < len(text):
            found.pop()                                     # what comes next may belong to the last match
            if not found:
                width *= 2
                continue
        if not found:
            return
        yield [text[a:b] for a, b in found]
        at, width = found[-1][1], SLICE_CHARS


_RANKS: dict[str, Ranks] = {}


def _ranks(path: str) -> Ranks:
    """A worker's vocabulary, kept between tasks."""
    if path not in _RANKS:
        _RANKS[path] = Ranks(path)
    return _RANKS[path]


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of about SLICE_CHARS characters; null is empty, bytes that are no UTF-8 become U+FFFD."""
    texts, size = [], 0
    for raw in column:
        text = (raw.as_py() or b"").decode("utf-8", "replace")
        texts.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit): the ids of every whole text.

    `path` is a rank file (a token in base64 and its rank in a line), at the same place on every machine; each match
    of `pattern` is encoded by itself, without special tokens.  A row for each row, repeated ones too; a null or empty
    text has no ids; null ids stay; other columns are not read; an empty table gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = _ranks(path), regex.compile(pattern)
        for batch in batches:
            row = 0
            for texts in _slices(batch.column(1)):
                if len(texts) == 1:
                    found = []
                    for part in words(texts[0], split):
                        found.append(b"".join(map(ranks.known(set(part)).__getitem__, part)))
                    coded = [b"".join(found)]
                else:
                    parts = [split.findall(t) for t in texts]
                    ids = ranks.known(set().union(*parts)).__getitem__
                    coded = [b"".join(map(ids, p)) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array([len(c) // 4 for c in coded], pa.int64()),
                     pa.array(coded, pa.binary())], [id_col, "n_tokens", "ids"])
                row += len(texts)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids binary")


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of `coded` and `decoded` (binary): the bytes that the ids stand for.  Null ids give no bytes.

    A column `decoded` that was there is replaced; an id that is not in the rank file is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _ranks(path).tokens
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            row, size, out = 0, 0, []
            for raw in batch.column(at):
                ids = np.frombuffer(raw.as_py() or b"", "<u4")
                out.append(b"".join(map(tokens.__getitem__, ids.tolist())))
                size += len(out[-1])
                if size >= SLICE_CHARS:
                    yield _with(batch.slice(row, len(out)), out)
                    row, size, out = row + len(out), 0, []
            if out:
                yield _with(batch.slice(row), out)

    def _with(batch: pa.RecordBatch, decoded: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    coded = coded.drop("decoded")
    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("decoded", BinaryType())]))
