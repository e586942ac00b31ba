"""SimHash near-duplicates: vantage-point trees over the fingerprints' Hamming distances.

A tree of vantage points deals the fingerprints out to shards.  At a node with vantage point p and cut m, what
lies within m + REACH of p goes left and what lies beyond m goes right, so by the triangle inequality any two
fingerprints within REACH of each other meet in some shard; only those near a boundary go both ways.  A shard
goes on in the same way in memory, down to leaves where all pairs are compared.  A leaf gives, for each group of
linked fingerprints, links to its least one; components join what the leaves found.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.operators.linking import components
from recordlake.session import cut_lineage

REACH = 3
SHINGLE_WORDS = 3
SHARD_ROWS = 32_768         # a shard larger than twice that is split again
LEAF_ROWS = 1024
SAMPLE_ROWS = 50_000        # fingerprints that vantage points and cuts are chosen on, at most, in each round
TRIES = 8                   # vantage points tried at a node

Node = tuple                # (vantage point, cut, left, right) or (shard,) or (shard, "dense")


# ---- fingerprints -----------------------------------------------------------------------------------------------

def fingerprint_of(text: str | None, words_in: int = SHINGLE_WORDS) -> int:
    """A bit is set if it is in over half of the shingles' hashes; texts without words have 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()         # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    if len(words) < words_in:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(words_in))))
    total = np.zeros(64, dtype=np.int64)
    n = 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    for start in range(0, len(hashes), 16_384):
        part = hashes[start:start + 16_384]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (as a signed 64-bit number) and two checksums of id and text of every row.

    Null texts are empty ones.
    """
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))
    return docs.select("doc_id", F.pandas_udf(of, "long")("text").alias("fingerprint"), *_marks())


def _marks() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("__mark"), F.xxhash64("text", F.lit(1), "doc_id").alias("__mark2")]


# ---- trees in memory --------------------------------------------------------------------------------------------

def distances(point: int, prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(point))


def choose(prints: np.ndarray, reach: int = REACH) -> tuple[int, int] | None:
    """The vantage point and cut whose larger side is least; None if no cut leaves less than nine tenths."""
    n, best = len(prints), None
    for point in prints[:: max(1, n // TRIES)][:TRIES].tolist():
        within = np.bincount(distances(point, prints), minlength=65).cumsum()
        left = np.concatenate([within[reach:], np.full(reach, n)])[:65]       # within cut + reach
        larger = np.maximum(left, n - within)
        cut = int(larger.argmin())
        if best is None or larger[cut] < best[0]:
            best = (larger[cut], point, cut)
    return best[1:] if best and best[0] < 0.9 * n else None


def build(sample: np.ndarray, most: float, name: str = "") -> Node:
    """A tree whose leaves hold at most `most` of the sample, where cuts allow it."""
    if len(sample) <= most:
        return (name,)
    found = choose(sample)
    if found is None:
        return (name, "dense")
    point, cut = found
    d = distances(point, sample)
    return (point, cut, build(sample[d <= cut + REACH], most, name + "0"), build(sample[d > cut], most, name + "1"))


def route(node: Node, prints: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """The leaves and what they hold."""
    if len(node) < 4:
        if len(prints):
            yield node[0], prints
    elif len(prints):
        point, cut, left, right = node
        d = distances(point, prints)
        yield from route(left, prints[d <= cut + REACH])
        yield from route(right, prints[d > cut])


def graft(node: Node, subtrees: dict[str, Node]) -> Node:
    if len(node) < 4:
        return subtrees.get(node[0], node)
    return (*node[:2], graft(node[2], subtrees), graft(node[3], subtrees))


def _least_of_groups(prints: np.ndarray) -> np.ndarray:
    """For each of some distinct fingerprints, the least of those that links between them reach."""
    n = len(prints)
    root = np.arange(n)
    if n <= 2 * LEAF_ROWS:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= REACH
        linked = np.flatnonzero(near.sum(axis=1) > 1)
        if len(linked):
            near, label = near[np.ix_(linked, linked)], linked.copy()
            while True:
                lower = np.where(near, label[None, :], n).min(axis=1)
                lower = np.minimum(lower, root[lower])
                if (lower == label).all():
                    break
                label = lower
                root[linked] = label
            root[linked] = label
        return prints[root]
    left = np.arange(n)             # each fingerprint is compared once with those that are not reached yet
    while len(left):
        first, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            reached = np.zeros(len(left), dtype=bool)
            for at in range(0, len(wave), 64):
                reached |= (np.bitwise_count(prints[wave[at:at + 64], None] ^ prints[left][None, :]) <= REACH).any(axis=0)
            wave, left = left[reached], left[~reached]
            root[wave] = first
    return prints[root]


def links(prints: np.ndarray) -> np.ndarray:
    """Links (fingerprint, least of its group) that connect just what links within REACH connect."""
    out = []
    stack = [np.unique(prints)]
    while stack:
        part = stack.pop()
        found = choose(part) if len(part) > LEAF_ROWS else None
        if found:
            d = distances(found[0], part)
            stack += [part[d <= found[1] + REACH], part[d > found[1]]]
        else:
            least = _least_of_groups(part)
            out.append(np.stack([part, least], axis=1)[part != least])
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


# ---- on Spark ---------------------------------------------------------------------------------------------------

def _routed(prints: DataFrame, tree: Node) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for shard, part in route(tree, values):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]).take(pa.array(np.zeros(len(part), np.int32))), pa.array(part.view(np.int64))], ["shard", "fingerprint"])
    return prints.select("fingerprint").mapInArrow(run, "shard string, fingerprint long")


def _sample(rows: DataFrame, total: int) -> pd.DataFrame:
    """At most SAMPLE_ROWS of `total` rows, those with the least hash of the fingerprint.

    Tasks send little more than that, since rows with larger hashes are left out where they lie.
    """
    number = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.lit(10 ** 9))
    if total > SAMPLE_ROWS:
        rows = rows.where(number < int(10 ** 9 * 1.1 * SAMPLE_ROWS / total) + 1)
    return rows.orderBy(number, "fingerprint").limit(SAMPLE_ROWS).toPandas()


def dealt(prints: DataFrame, shard_rows: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """shard and fingerprint of distinct fingerprints, dealt out by a tree, and the sizes of its dense shards, those
    that are too large though no cut splits them.

    Each round chooses vantage points on a bounded sample and splits the shards that are too large; sizes come to
    the driver only for those.
    """
    shard_rows = shard_rows or SHARD_ROWS
    n = prints.count()
    sample = _sample(prints, n)["fingerprint"].to_numpy(np.int64).view(np.uint64)
    tree = build(sample, max(1.0, shard_rows * len(sample) / max(n, 1)))
    while True:
        routed = cut_lineage(_routed(prints, tree))
        large = {r.shard: r.n for r in routed.groupBy("shard").agg(F.count("*").alias("n"))
                 .where(F.col("n") > 2 * shard_rows).collect()}
        dense = {s: c for s, c in large.items() if s in _dense(tree)}
        open_shards = sorted(large.keys() - dense.keys())
        if not open_shards:
            return routed, dense
        part = _sample(routed.where(F.col("shard").isin(open_shards)), sum(large[s] for s in open_shards))
        subtrees = {}
        for shard in open_shards:
            own = part.loc[part["shard"] == shard, "fingerprint"].to_numpy(np.int64).view(np.uint64)
            subtrees[shard] = build(own, max(1.0, shard_rows * len(own) / large[shard]), shard)
            if len(subtrees[shard]) < 4 and len(own):
                subtrees[shard] = (shard, "dense")
        tree = graft(tree, subtrees)


def _dense(node: Node) -> set[str]:
    if len(node) < 4:
        return {node[0]} if len(node) == 2 else set()
    return _dense(node[2]) | _dense(node[3])


def similar(prints: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints that connect just what links within REACH connect."""
    shard_rows = shard_rows or SHARD_ROWS
    routed, dense = dealt(prints, shard_rows)
    routed = routed.withColumn("cell", F.lit(0).cast("long"))
    if dense:
        # rows of a dense shard are dealt into blocks, and each pair of blocks meets in a cell of its own
        blocks = F.lit(1)
        for shard, size in dense.items():
            blocks = F.when(F.col("shard") == shard, -(-size // shard_rows)).otherwise(blocks)
        routed = (routed.withColumn("n", blocks.cast("long"))
                  .withColumn("block", F.pmod(F.xxhash64("fingerprint", F.lit(2)), F.col("n")))
                  .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
                  .withColumn("cell", F.least("block", "other") * F.col("n") + F.greatest("block", "other")))

    def compare(table: pa.Table) -> pa.Table:
        found = links(table.column("fingerprint").to_numpy().view(np.uint64))
        return pa.table({"a": found[:, 0].copy().view(np.int64), "b": found[:, 1].copy().view(np.int64)})

    return (routed.select("shard", "cell", "fingerprint").groupBy("shard", "cell").applyInArrow(compare, "a long, b long")
            .distinct())


def group(prints: DataFrame) -> DataFrame:
    """The rows of `prints` (doc_id, fingerprint as a signed number, any others) with their component_id:
    the smallest doc_id that links reach, null if all of those are null; and with their label, the least
    fingerprint that links reach, which no other component has.  `prints` is read several times, so it should be a
    written table.
    """
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    of = components(similar(classes)).select(F.col("node").alias("fingerprint"), F.col("component"))
    linked = cut_lineage(of.join(classes, "fingerprint"))
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("fingerprint", "least", "component")
    labels = classes.join(named, "fingerprint", "left").select(
        F.col("fingerprint").alias("__print"), F.coalesce("least", "first").alias("component_id"),
        F.coalesce("component", "fingerprint").alias("label"))
    return (prints.join(labels, F.col("fingerprint") == F.col("__print"))
            .drop("__print"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of `docs`.

    Null and texts without words have fingerprint zero and are linked like others; a null doc_id is listed and
    names no component unless all of its ids are null; repeated rows are listed each; an empty table gives an
    empty result; other columns play no part.
    """
    prints = cut_lineage(fingerprints(docs))
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return group(prints).select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, one for each component: that of its smallest doc_id.

    Of rows that share this id, and of a component without ids, one stays: the one with the least checksum of id
    and text, then the least columns.  Components that share an id, or have none, keep a row each.
    """
    rows = group(cut_lineage(fingerprints(docs)))
    return rows_of(docs, least_of_each(rows, "label"))


def least_of_each(rows: DataFrame, label: str) -> DataFrame:
    """__mark, __mark2: of the rows with the same label the one with the smallest doc_id, null last."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__mark", "__mark2")
    return rows.groupBy(label).agg(F.min(order).alias("m")).select("m.__mark", "m.__mark2")


def rows_of(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of `docs` whose checksums are in `keep`; the least columns of those with the same."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*cols).alias("__row"), *_marks())
    return (marked.join(keep, ["__mark", "__mark2"]).groupBy("__mark", "__mark2").agg(F.min("__row").alias("__row"))
            .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
