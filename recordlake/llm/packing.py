"""Packing token sequences into windows: sum-of-squares online packing.

Every task packs the documents it reads.  An array counts its partially filled windows by fill level; a document
goes to the level (or opens a window) that minimises the sum of the squared counts.  At the end of a task the
windows still open are poured together by cutting documents, and the one that remains is cut into sequences
whose lengths are powers of two, which need no padding.  Nothing is shuffled.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
OPEN_WINDOWS = 512          # a task holds at most so many open windows; beyond, the emptiest are poured together
END_ID = 2
MEMORY_WORDS = 300_000      # words whose ids a worker remembers, twice at most
LATIN_END = "\u0250"        # below, lower case is the same by any rule
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"        # ASCII without the apostrophe
TASK_BITS = 36              # a task's sequences are numbered below 2 ** TASK_BITS

Piece = tuple[int, int, np.ndarray]     # document's place in the task, ids before it, ids


class WordIds:
    """Ids of texts for a tokenizer that treats the words between ASCII blanks one by one.

    Words are looked up, in two generations of MEMORY_WORDS or a batch more.  Unknown words of letters, with
    ASCII punctuation behind them or not, are lower-cased and go to the tokenizer many at a time, if it marks the
    ends of words; others go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.folds = bool(suffix) and self._one_by_one(["Aé".encode()]) == self._one_by_one(["aé".encode()])
        self.tails: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        new, old = self.new, self.old
        unknown = [w for w in set().union(*split) if w not in new]
        if unknown:
            new.update((w, old[w]) for w in unknown if w in old)
            self._learn([w for w in unknown if w not in old])
        ids = new.__getitem__
        out = [np.frombuffer(b"".join(map(ids, words)), dtype="<u4") for words in split]
        if len(self.new) > MEMORY_WORDS:
            self.old, self.new = self.new, {}
        return out

    def _learn(self, words: list[bytes]) -> None:
        new, old = self.new, self.old
        stems: dict[bytes, None] = {}
        made, rest = [], []
        for w in words:
            text = "" if w.isascii() else w.decode("utf-8", "replace")
            if self.folds and (not text or max(text) < LATIN_END):
                low = unicodedata.normalize("NFC", text).lower().encode() if text else w.lower()
                stem = low.rstrip(PUNCTUATION)
                if stem.isalpha() or stem and not stem.isascii() and stem.decode().isalpha():
                    if stem not in new:
                        if stem in old:
                            new[stem] = old[stem]
                        else:
                            stems[stem] = None
                    if stem != w:
                        made.append((w, stem, low[len(stem):]))
                    continue
            rest.append(w)
        self._spell(list(stems))
        tails = self.tails
        for w, stem, tail in made:
            if tail not in tails:
                if len(tails) > 10_000:
                    tails.clear()
                tails[tail] = self._one_by_one([tail])[0] if tail else b""
            new[w] = new[stem] + tails[tail]
        for start in range(0, len(rest), 5000):
            new.update(zip(rest[start:start + 5000], self._one_by_one(rest[start:start + 5000])))

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.encode([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _spell(self, words: list[bytes]) -> None:
        """Learns words of letters, hundreds to a text, told apart by the marks at their ends."""
        for start in range(0, len(words), 400):
            part = words[start:start + 400]
            ids = np.array(self.encode([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, at = ids.tobytes(), (4 * ends).tolist()
                self.new.update(zip(part, map(raw.__getitem__, map(slice, [0, *at[:-1]], at))))
            else:
                self.new.update(zip(part, self._one_by_one(part)))


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """A worker's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


class Packer:
    """Open windows by fill level; full windows come out as lists of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open = window, most_open
        self.count = np.zeros(window + 1, dtype=np.int64)      # of open windows at each level
        self.held: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield [(doc, start, ids[start:start + self.window])]
        rest = ids[whole:]
        if len(rest):
            level = self.best_level(len(rest))
            pieces = self._take(level) if level else []
            pieces.append((doc, whole, rest))
            if level + len(rest) == self.window:
                yield pieces
            else:
                self._put(level + len(rest), pieces)
                if self.open > self.most_open:
                    yield from self._pour(self._emptiest(self.open // 2))

    def best_level(self, size: int) -> int:
        """The level, 0 for a new window, after which the sum of squared counts is least; the fullest of equals.

        Moving a window from level h to h + size changes the sum by 2 * (N[h + size] - N[h] + 1); a new window
        has no first term, a full window no second one.
        """
        count, last = self.count, self.window - size
        change = 2 * (count[size:] - count[:last + 1] + 1)
        change[0] = 2 * count[size] + 1
        change[last] = 1 - 2 * count[last] if last else 0
        change[1:][count[1:last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(change[::-1].argmin())

    def finish(self) -> Iterator[list[Piece]]:
        """The rest: full windows, then sequences whose lengths are powers of two."""
        yield from self._pour(self._emptiest(self.open))
        for level in list(self.held):
            pieces = self._take(level)
            for bit in reversed(range(level.bit_length())):
                if level >> bit & 1:
                    part, pieces = cut(pieces, 1 << bit)
                    yield part

    def _take(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.open -= 1
        pieces = self.held[level].pop()
        if not self.held[level]:
            del self.held[level]
        return pieces

    def _put(self, level: int, pieces: list[Piece]) -> None:
        self.count[level] += 1
        self.open += 1
        self.held.setdefault(level, []).append(pieces)

    def _emptiest(self, n: int) -> list[tuple[int, list[Piece]]]:
        levels = [level for level in sorted(self.held) for _ in self.held[level]][:n]
        return [(level, self._take(level)) for level in levels]

    def _pour(self, windows: list[tuple[int, list[Piece]]]) -> Iterator[list[Piece]]:
        """Fills the fullest from the emptiest; at most one of them stays open."""
        low, high = 0, len(windows) - 1
        while low < high:
            level, pieces = windows[high]
            least, source = windows[low]
            taken, source = cut(source, min(self.window - level, least))
            level, least = level + sum(len(i) for *_, i in taken), sum(len(i) for *_, i in source)
            windows[high], windows[low] = (level, pieces + taken), (least, source)
            if level == self.window:
                yield windows[high][1]
                high -= 1
            if not least:
                low += 1
        if low == high:
            self._put(*windows[low])


def cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first `size` ids, and the rest."""
    head: list[Piece] = []
    for n, (doc, start, ids) in enumerate(pieces):
        if len(ids) > size:
            if size:
                head.append((doc, start, ids[:size]))
            return head, [(doc, start + size, ids[size:]), *pieces[n + 1:]]
        head.append((doc, start, ids))
        size -= len(ids)
    return head, []


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece of a document.

    ids: little-endian unsigned 32-bit numbers as bytes.  tokenizer: the path of a tokenizer file that every
    executor has, one that treats the words between blanks one by one.  A document's ids end with `end_id`, so
    null and empty texts have that one.  A null doc_id is kept; repeated rows are packed each; an empty table
    gives no pieces; other columns play no part.  Memory: a batch of texts and OPEN_WINDOWS windows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << TASK_BITS
        encode, packer = encoder(tokenizer), Packer(window)
        known: dict[int, list] = {}         # documents with ids in open windows: doc_id, ids, ids still to come out
        rows: list[tuple] = []
        place = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids in pieces:
                of = known[doc]
                rows.append((of[0], start, len(ids), ids.tobytes(), of[1], sequence, offset))
                offset += len(ids)
                of[2] -= len(ids)
                if not of[2]:
                    del known[doc]
            sequence += 1

        def drain() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    known[place] = [doc_id, len(ids), len(ids)]
                    for pieces in packer.add(place, ids):
                        emit(pieces)
                    place += 1
                if len(rows) >= 256:
                    yield drain()
        for pieces in packer.finish():
            emit(pieces)
        yield drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                        "doc_tokens", "sequence_id", "offset")


def padding(lengths: list[int], window: int = WINDOW) -> int:
    """Ids of padding that sequences of these lengths need: up to the window, none at a power of two."""
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths)
