"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows of the centred matrix X stay where they are, in blocks; the driver holds vectors as long as an embedding
only.  A step takes a right vector v, forms w = Xv - beta u on the blocks and sums X'w, w'w and U'w over them in the
same pass, so that the product with X and the one with its transpose cost one reading.  Left vectors are never stored: each is
X times a known combination, and a block works its own entries out again.  Both sides are orthogonalised in full,
the left one by further passes where much of w cancels.  Where a side runs out, a new start vector goes on, so equal deviations are found
as often as they occur.  The singular values of the small bidiagonal matrix are the deviations, its right vectors
give the components.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.session import cut_lineage

SCALE, OFFSET = 1024.0, 100_000         # an entry c is floor(SCALE * c) + OFFSET
LEAST = 1e-9                            # a component needs this part of the largest deviation
EXACT = 1e-13                           # a component counts as found when its residual is this part of the largest deviation
HELD = 2.0 ** 61                        # entries beyond are held there


@dataclass
class Fit:
    """Components as columns, with the deviation along each, and what they were fitted on."""
    n: int
    sums: list[int]
    trace: float                        # of the covariance
    components: np.ndarray              # length x components
    deviations: np.ndarray
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    values = np.asarray(column.flatten(), dtype=np.float64)
    return np.clip(np.floor(SCALE * values), -HELD, HELD).astype(np.int64).reshape(-1, d) + OFFSET


def _pack(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(0), d)
                small = np.abs(x).max() < 2 ** 31
                raw = x.astype(np.int32 if small else np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([raw], pa.binary())], ["n", "matrix"])
    return run


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_buffer()
            yield np.frombuffer(raw, np.int32 if raw.size == 4 * n * d else np.int64).reshape(n, d)


def _summed(blocks: DataFrame, d: int, size: int, part) -> np.ndarray:
    """The sum over all blocks of `part(matrix)`, an array of `size` doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _matrices(batches, d):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    out = np.zeros(size)
    for at, value in blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


def _totals(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows there are and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, d):
            high, low = (x >> 20).sum(axis=0), (x & (2 ** 20 - 1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(x))), pa.array(high), pa.array(low)],
                                             ["at", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = blocks.mapInArrow(run, "at int, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), *wide).collect()
    sums = {r["at"]: int(r["high"]) * 2 ** 20 + int(r["low"]) for r in rows}
    return rows[0]["n"], [sums[j] for j in range(d)]


class _Bidiagonal:
    """The state of the bidiagonalisation: right vectors, combinations that give the left ones, and X' times those."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray, scale: float):
        self.blocks, self.mean, self.d = blocks, mean, len(mean)
        self.none = LEAST * 1e-2 * scale                    # below, a vector has run out
        self.v, self.y, self.a = [], [], []                 # right vectors; left u = X y; a = X'u
        self.entries: list[tuple[int, int, float]] = []     # of the bidiagonal matrix: left, right, value
        self.beta = 0.0
        self.passes = 0
        self.rng = np.random.default_rng(self.d)
        self.v.append(self._fresh())

    def _fresh(self) -> np.ndarray:
        """A unit vector at right angles to all right vectors so far."""
        while True:
            v = self._off(self.rng.normal(size=self.d))
            size = np.linalg.norm(v)
            if size > 1e-6:
                return self._off(v / size) / np.linalg.norm(self._off(v / size))

    def _off(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for w in self.v:
                v = v - w * (w @ v)
        return v

    def _pass(self, z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """w'w, U'w and X'w of w = Xz."""
        mean, d, k = self.mean, self.d, len(self.y)
        y = np.array(self.y).T.reshape(d, k)
        self.passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            w = x @ z
            return np.concatenate([[w @ w], (x @ y).T @ w, x.T @ w])

        out = _summed(self.blocks, d, 1 + k + d, part)
        return out[0], out[1:1 + k], out[1 + k:]

    def step(self) -> None:
        """One more left vector and the right vector after it."""
        v = self.v[-1]
        z = v - self.beta * self.y[-1] if self.beta else v
        for _ in range(4):
            before, h, g = self._pass(z)
            for c, y, a in zip(h, self.y, self.a):
                z, g = z - c * y, g - c * a
            left = before - h @ h
            # without much cancellation one pass is enough
            if left > 0.5 * before or before <= self.none ** 2:
                break
        alpha = np.sqrt(max(left, 0.0))
        if alpha > self.none:
            self.y.append(z / alpha)
            self.a.append(g / alpha)
            self.entries.append((len(self.y) - 1, len(self.v) - 1, alpha))
            rest = self._off(self.a[-1] - alpha * v)
            self.beta = float(np.linalg.norm(rest))
        else:
            self.beta = 0.0                                 # Xv lies in the left vectors that there are
        if len(self.v) == self.d:
            return
        if self.beta > self.none:
            self.v.append(self._off(rest / self.beta))
            self.entries.append((len(self.y) - 1, len(self.v) - 1, self.beta))
        else:
            self.restart()

    def restart(self) -> None:
        self.beta = 0.0
        self.v.append(self._fresh())

    def solve(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors as columns, and what each lacks of being exact."""
        b = np.zeros((max(1, len(self.y)), len(self.v)))
        for i, j, value in self.entries:
            b[i, j] = value
        left, s, right = np.linalg.svd(b, full_matrices=False)
        last = np.abs(left[-1]) * self.beta if self.y else np.zeros(len(s))
        return s, np.array(self.v).T @ right.T, last


def _components(blocks: DataFrame, mean: np.ndarray, scale: float, want: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The `want` largest singular values of X, their right vectors and the passes it took."""
    run = _Bidiagonal(blocks, mean, scale)
    found, until = None, 0
    while True:
        done = len(run.v) == run.d
        run.step()
        if done:
            break
        if len(run.y) < 2 * want or len(run.y) < until:
            continue
        s, _, lack = run.solve()
        if (lack[:want] > EXACT * s[0]).any():
            continue
        if found is not None and np.allclose(s[:want], found, rtol=1e-12, atol=EXACT * s[0]):
            break
        # what one start vector cannot show, such as a second copy of a deviation, a new one must
        found, until = s[:want].copy(), len(run.y) + want
        if run.beta:
            run.entries.pop()
            run.v.pop()
            run.restart()
    s, right, _ = run.solve()
    keep = s[:want] > LEAST * s[0]
    return s[:want][keep], right[:, :want][:, keep], run.passes


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(f"`{vector_col}`")
    return vectors.where(usable(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), vector.cast("array<double>").alias("v"))


def _length(rows: DataFrame) -> int | None:
    """The commonest length of a vector, the larger one of a tie."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found and found[0]["d"] > 0 else None


def fit(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> Fit | None:
    """Components of the centred vectors by falling deviation, `most` at most; None where nothing varies.

    Each entry c becomes floor(1024 * c) + 100000.  Vectors that are null or hold null or non-finite entries, and
    those of another length than the commonest, take no part; repeated rows count each time.
    """
    rows = _rows(vectors, id_col, vector_col)
    d = _length(rows)
    if d is None:
        return None
    blocks = cut_lineage(rows.where(F.size("v") == d).select("v").mapInArrow(_pack(d), "n long, matrix binary"))
    n, sums = _totals(blocks, d)
    mean = np.array([s / n for s in sums])
    spread = float(_summed(blocks, d, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0])
    if spread == 0:
        return None
    s, right, passes = _components(blocks, mean, np.sqrt(spread / d), min(most, d))
    deviations = s / np.sqrt(n)
    k = len(s)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ right / deviations
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = _summed(blocks, d, k + k * k, moments) / n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return Fit(n, sums, spread / n, right, deviations, float(np.abs(covariance - np.eye(k)).max()), passes)


def _squares(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n * x - S) ** 2, exact; null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    if n * float(np.abs(x).max(initial=0)) < 2 ** 61:
        q = n * x - np.array(sums, dtype=np.int64)
        if float(np.abs(q).max(initial=0)) ** 2 * x.shape[1] < 2 ** 62:
            return pa.array((q * q).sum(axis=1)).cast(kind)
    q = x.astype(object) * n - np.array(sums, dtype=object)
    out = [int(v) for v in (q * q).sum(axis=1)]
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in out], kind)


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component int, n long, deviation decimal, whitened double, explained double, identity_error double.

    A row for each vector that takes part (see `fit`) and each component, numbered from 1 by falling deviation.
    `whitened` is the centred vector along the component over its deviation; `deviation` the exact sum over
    dimensions of (n * x - S) ** 2 with S the sums over the n vectors, null beyond 38 digits; `explained` the
    component's part of all variance; `identity_error` how far the covariance of `whitened` is from the identity.
    Components with less than a thousand-millionth of the largest deviation are left out; vectors that are all equal, and empty
    tables, give no rows.  Null ids stay, repeated rows each have their rows, other columns are not read.
    """
    rows = _rows(vectors, id_col, vector_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    found = fit(vectors, most, id_col, vector_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, mean, d = found.n, found.sums, found.mean, len(found.sums)
    directions = found.components / found.deviations
    explained = found.deviations ** 2 / found.trace
    k, error = len(explained), found.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(1), d)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                _squares(x, n, sums).take(at), pa.array(((x - mean) @ directions).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("v") == d).mapInArrow(run, schema)
