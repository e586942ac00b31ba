"""Exact top-k search by distributed histogram selection.

Vectors are laid out in blocks, and every block of queries meets every block of candidates.  No score is kept:
a first pass counts, for each query, scores in the bins of a global histogram; the bin that holds the kth largest
is refined in the next pass, until it holds a single value.  The last pass returns scores at or above that value,
with ties broken by the smaller id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.session import cut_lineage

BLOCK_ROWS = 2048
BINS = 4096
LIMIT = 2 ** 61             # components and scores beyond are held there

_BLOCK = "block long, dim int, ids binary, names binary, matrix binary, norm double"


def _integers(vectors: list) -> np.ndarray:
    x = np.floor(256.0 * np.array(vectors, dtype=np.float64))
    return np.clip(x, -float(LIMIT), float(LIMIT)).astype(np.int64)


def _usable(vec: Column) -> Column:
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(odd, F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v, row: the vectors that take part, with a number of their own, for ids may come again.  To be written before use."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """A row for each block of about BLOCK_ROWS vectors of one length: ids and the integer matrix as bytes."""
    n = -(-count // BLOCK_ROWS)

    def build(table: pa.Table) -> pa.Table:
        names, ids = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("vec_id", "row"))
        vectors = table.column("v").to_pylist()
        block = table.column("block")[0].as_py()
        out = []
        for dim in sorted(set(map(len, vectors))):
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            at.sort(key=lambda i: (names[i], ids[i]))
            matrix = _integers([vectors[i] for i in at]).reshape(len(at), dim)
            norm = float(np.sqrt((matrix.astype(float) ** 2).sum(axis=1)).max())
            small = matrix.size == 0 or np.abs(matrix).max() < 2 ** 31
            out.append((block, dim, ids[at].tobytes(), names[at].tobytes(), matrix.astype(np.int32 if small else np.int64).tobytes(), norm))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()))],
                        names=["block", "dim", "ids", "names", "matrix", "norm"])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, n))))
    return keyed.groupBy("block").applyInArrow(build, _BLOCK)


def _matrix(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    raw, cells = row[f"{prefix}matrix"], len(ids) * row["dim"]
    kind = np.int32 if len(raw) == 4 * cells else np.int64
    return ids, np.frombuffer(raw, kind).astype(np.int64).reshape(len(ids), row["dim"])


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.array([[max(-LIMIT, min(LIMIT, int(s))) for s in row] for row in exact], np.int64).reshape(len(q), len(c))


_NEVER = np.iinfo(np.int64).min


def _pairs(queries: DataFrame, candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Every block of queries, with the state of its queries, beside every block of candidates of its length."""
    held = state.groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "high"))).alias("state"))
    left = (queries.join(held, ["block", "dim"])
            .select(F.col("block").alias("q"), "dim", F.col("ids").alias("q_ids"), F.col("names").alias("q_names"), F.col("matrix").alias("q_matrix"), "state"))
    right = candidates.select(F.col("block").alias("c"), "dim", F.col("ids").alias("c_ids"), F.col("names").alias("c_names"), F.col("matrix").alias("c_matrix"))
    left_keys = left.select("q", "dim").distinct()
    right_keys = right.select("c", "dim").distinct()
    # both sides are dealt out by the pair of blocks; a pair has one row on either side
    left = left.join(right_keys, "dim")
    right = right.join(left_keys, "dim")
    return left.join(right, ["q", "c", "dim"])


def _counts(k: int):
    """For each query the counts of its bins, from the bin of the block's own kth best on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (q_ids, q), (c_ids, c) = _matrix(row, "q_"), _matrix(row, "c_")
                state = {s["query_id"]: (s["low"], s["high"]) for s in row["state"]}
                low, high = (np.array([state[i][n] for i in q_ids.tolist()], np.int64)[:, None] for n in (0, 1))
                width = -(-(high - low) // BINS)
                s = _scores(q, c)
                s[q_ids[:, None] == c_ids[None, :]] = _NEVER
                kth = np.partition(s, len(c_ids) - k, axis=1)[:, len(c_ids) - k, None] if len(c_ids) > k else low
                least = np.where(kth > low, low + (np.minimum(kth, high) - low) // width * width, low)
                at, col = np.nonzero((s >= least) & (s < high))
                cell, n = np.unique(at * BINS + (s[at, col] - low[at, 0]) // width[at, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[cell // BINS]), pa.array(cell % BINS), pa.array(n)], ["query_id", "bin", "n"])
    return run


def _winners(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (q_ids, q), (c_ids, c) = _matrix(row, "q_"), _matrix(row, "c_")
                state = {s["query_id"]: s["low"] for s in row["state"]}
                low = np.array([state[i] for i in q_ids.tolist()], np.int64)[:, None]
                s = _scores(q, c)
                s[q_ids[:, None] == c_ids[None, :]] = _NEVER
                tie = s == low
                take = ((s > low) | tie & (tie.cumsum(axis=1) <= k)) & (s != _NEVER)     # ids of a block ascend
                at, col = np.nonzero(take)
                q_names, c_names = (np.frombuffer(row[f"{p}names"], np.int64) for p in ("q_", "c_"))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(q_names[at]), pa.array(c_ids[col]), pa.array(c_names[col]), pa.array(s[at, col])],
                                                 ["q_row", "query_id", "c_row", "vec_id", "score"])
    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates other than itself, all if fewer.

    Both frames have vec_id, v and row, as `usable` gives them; a row is no candidate of its own, one with the same id is.  The score is the inner product of floor(256 * x);
    equal scores are ordered by vec_id.  Vectors meet vectors of their own length only.  No queries or no
    candidates give an empty result.
    """
    queries, candidates = cut_lineage(queries), cut_lineage(candidates)
    q = cut_lineage(_blocks(queries, queries.count()))
    c = cut_lineage(_blocks(candidates, candidates.count()))
    longest = c.groupBy("dim").agg(F.max("norm").alias("longest"))
    # |score| <= product of norms
    bound = F.least(F.lit(float(LIMIT)), F.ceil(F.col("norm") * F.col("longest") * (1 + 1e-9)) + 1).cast("long")
    members = _ids(q).join(longest, "dim").withColumn("bound", bound)
    state = cut_lineage(members.select("block", "dim", "query_id", (-F.col("bound")).alias("low"), F.col("bound").alias("high"), F.lit(0).cast("long").alias("above")))
    while state.where(F.col("high") - F.col("low") > 1).limit(1).count():
        counts = (_pairs(q, c, state).mapInArrow(_counts(k), "query_id long, bin long, n long")
                  .groupBy("query_id", "bin").agg(F.sum("n").alias("n")))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        found = (counts.join(state, "query_id").withColumn("upto", F.sum("n").over(down) + F.col("above"))
                 .where(F.col("upto") >= k).groupBy("query_id")
                 .agg(F.max("bin").alias("bin"), F.min(F.col("upto")).alias("upto"), F.max_by("n", "bin").alias("n")))
        width = F.ceil((F.col("high") - F.col("low")) / BINS).cast("long")
        low = F.col("low") + F.col("bin") * width
        # without a kth best all candidates are wanted
        state = cut_lineage(state.join(found, "query_id", "left").select(
            "block", "dim", "query_id", F.when(F.col("bin").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("bin").isNull(), F.col("low") + 1).otherwise(F.least("high", low + width)).alias("high"),
            F.when(F.col("bin").isNull(), F.col("above")).otherwise(F.col("upto") - F.col("n")).alias("above")))
    best = _pairs(q, c, state).mapInArrow(_winners(k), "q_row long, query_id long, c_row long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "c_row")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _ids(blocks: DataFrame) -> DataFrame:
    """block, dim, norm, query_id of every vector in the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * n, pa.int64()), pa.array([row["dim"]] * n, pa.int32()),
                                                  pa.array([row["norm"]] * n, pa.float64()), pa.array(ids)], ["block", "dim", "norm", "query_id"])
    return blocks.mapInArrow(run, "block long, dim int, norm double, query_id long")


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """`top_k` with the vectors whose id is divisible by `every` as queries, against all.

    Null ids and vectors that are null or hold null or non-finite components take no part; rows with the same id are
    rows of their own, as queries and as candidates; other columns play no part.
    """
    rows = cut_lineage(usable(vectors))
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
