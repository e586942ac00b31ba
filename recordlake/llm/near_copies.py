"""Near copies by the Jaccard similarity of five-word shingles: MinHash bands give candidates, the texts decide.

Each text has BANDS keys of ROWS least hashes; texts with a key in common are candidates.  Two texts of similarity
s share none with probability (1 - s ** ROWS) ** BANDS, at 0.8 three in a million, and less above.  Candidates are
verified on the exact sets of shingles.  Texts with the same set are one node from the start.

Where a key is common to many, its texts are first compared with one of them, round by round, so that most are
linked before the pairs that are left are compared, all of them.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm import simhash
from recordlake.llm.texts import numbers, packed, prefix_sums, span_hashes, unpacked
from recordlake.operators.linking import components
from recordlake.session import cut_lineage

SHINGLE_WORDS = 5
SIMILAR = (4, 5)                # a similarity of four fifths
BANDS, ROWS = 24, 4
LEAST_SHINGLES = 4              # smaller sets are as similar as that to equal ones only
STAR_ROUNDS = 4                 # rounds against one text of each key, at most, while pairs are many
PAIRS_A_NODE = 20

_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 2 ** 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 2 ** 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()                 # bytes: A-Z and ASCII blanks only


def shingles(text: bytes) -> frozenset:
    """The spans of five words; fewer words are one span."""
    words = words_of(text)
    if len(words) < SHINGLE_WORDS:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(SHINGLE_WORDS))))


def similar(a: frozenset, b: frozenset) -> bool:
    common = len(a & b)
    return SIMILAR[1] * common >= SIMILAR[0] * (len(a) + len(b) - common)


def hashes_of(text: bytes) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    words = words_of(text)
    n = min(len(words), SHINGLE_WORDS)
    if not n:
        return np.zeros(0, np.uint64)
    found = span_hashes(prefix_sums(numbers(words)), np.arange(len(words) - n + 1), n)
    return np.unique(found)


def keys_of(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for start in range(0, len(hashes), 2048):
        part = hashes[None, start:start + 2048]
        np.minimum(least, ((part ^ _XOR) * _TIMES).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - 2 ** 63 for i, band in enumerate(least.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, checksums, node (a hash of the set of shingles), n (its size) and keys of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(3):
                hashes = hashes_of((text.as_py() or "").encode("utf-8", "replace"))
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), 7) - 2 ** 63)
                sizes.append(len(hashes))
                keys.append(keys_of(hashes) if len(hashes) >= LEAST_SHINGLES else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "__mark", "__mark2", "node", "n", "keys"])
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", *simhash._marks(), "text")
            .mapInArrow(run, f"doc_id {doc_id}, __mark long, __mark2 long, node long, n long, keys array<long>"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: the pairs of nodes whose texts are similar."""
    pairs = cut_lineage(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    marks = nodes.join(wanted, "node", "left_semi").select("node", "__mark", "__mark2")
    texts = docs.select(*simhash._marks(), "text").join(marks, ["__mark", "__mark2"]).dropDuplicates(["node"])
    texts = cut_lineage(texts.select("node", packed(F.col("text")).alias("raw")))

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = lru_cache(256)(lambda raw: shingles(unpacked(raw)))
        return pd.Series([similar(sets(x), sets(y)) for x, y in zip(a, b)], dtype=bool)
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("a_raw")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("raw").alias("b_raw")), "b"))
    return both.where(F.pandas_udf(of, "boolean")("a_raw", "b_raw")).select("a", "b")


def _sized(a: str, b: str):
    """Sets of such sizes can be similar."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def linked(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component of the nodes with a similar one; `nodes` has the checksums, n and keys of one row of each."""
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n")
    common = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    held = cut_lineage(rows.join(common, "key").withColumn("component", F.col("node")))
    edges, found = None, None
    for round_ in range(STAR_ROUNDS + 1):
        # keys whose texts are all in one component are done
        open_ = held.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.min(F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node", "n", "component")).alias("pivot")).where("low < high")
        open_ = cut_lineage(open_)
        pairs, keys = open_.agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2), F.sum("c")).first()
        if not pairs:
            break
        last = round_ == STAR_ROUNDS or pairs <= PAIRS_A_NODE * keys
        if last:
            left = held.join(open_.select("key"), "key", "left_semi")
            right = left.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("component").alias("component2"))
            beside = left.join(right, "key").where("node < node2")
        else:
            beside = held.join(open_.select("key", F.col("pivot.node").alias("node2"), F.col("pivot.n").alias("n2"), F.col("pivot.component").alias("component2")), "key")
        beside = beside.where((F.col("component") != F.col("component2")) & _sized("n", "n2"))
        new = _verified(beside.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")), nodes, docs)
        edges = cut_lineage(new if edges is None else edges.union(new))
        found = cut_lineage(components(edges))
        if last:
            break
        held = cut_lineage(held.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    return found if found is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, one for each group of near copies: that of its smallest doc_id.

    Of rows that share this id, and of a group without ids, one stays, as in `simhash.first_of_each`.  Texts without
    words are one group.  `docs` is read several times, so it should be a written table.
    """
    rows = cut_lineage(signatures(docs))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min_by(F.struct("__mark", "__mark2", "n", "keys"), F.struct("__mark", "__mark2")).alias("r"))
                        .select("node", "r.*"))
    labels = linked(nodes, docs)
    labelled = rows.select("doc_id", "__mark", "__mark2", "node").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    return simhash.rows_of(docs, simhash.least_of_each(labelled, "label"))
