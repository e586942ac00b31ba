"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training takes a bounded sample of labelled documents.  The trees are flattened into arrays, and documents are
scored where they lie, a batch at a time, by numpy steps down all trees at once.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000        # labelled documents that a classifier is fitted on, at most
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 20
THRESHOLD = 0.7

STATISTICS = (
    "bytes", "words", "word length", "upper-case share", "digit share", "blank share", "non-ASCII share",
    "exclamation marks", "full stops", "commas", "bars", "symbols", "brackets", "lines a word", "distinct words",
    "commonest word", "distinct lines", "distinct neighbours", "long words")

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, *range(9, 14)),
            "high": range(128, 256), "shout": b"!?", "stop": b".", "comma": b",;:", "bar": b"|", "symbol": b"#*$%&@_=~^",
            "bracket": b"<>{}[]()/\\"}
_MATRIX = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _MATRIX[list(_members), _i] = 1


def statistics(texts: pd.Series) -> np.ndarray:
    """A row of STATISTICS for each text; whole texts, null like empty."""
    out = np.zeros((len(texts), len(STATISTICS)))
    counts = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        n = len(words) or 1
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        lines = raw.split(b"\n")
        out[i, 0] = len(raw)
        out[i, 1] = len(words)
        out[i, 14] = len(tally) / n
        out[i, 15] = max(tally.values(), default=0) / n
        out[i, 16] = len(set(lines)) / len(lines)
        out[i, 17] = len(set(zip(words, words[1:]))) / n
        out[i, 18] = sum(map((12).__lt__, map(len, words))) / n
    c = dict(zip(_CLASSES, (counts @ _MATRIX).T))
    size, words = np.maximum(out[:, 0], 1), np.maximum(out[:, 1], 1)
    out[:, 2] = (out[:, 0] - c["blank"]) / words
    out[:, 3] = c["upper"] / np.maximum(c["upper"] + c["lower"], 1)
    for k, name in ((4, "digit"), (5, "blank"), (6, "high")):
        out[:, k] = c[name] / size
    for k, name in ((7, "shout"), (8, "stop"), (9, "comma"), (10, "bar"), (11, "symbol"), (12, "bracket")):
        out[:, k] = c[name] / words
    out[:, 13] = counts[:, 10] / words
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: inner nodes go left where value <= cut; leaves hold log-odds."""
    feature: np.ndarray     # trees x (2^depth - 1)
    cut: np.ndarray         # trees x (2^depth - 1)
    leaf: np.ndarray        # trees x 2^depth
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if not len(self.leaf):
            return total
        tree = np.arange(len(self.leaf))[None, :]
        row = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return total + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts TREES trees of DEPTH levels on log loss, over histograms of at most BINS quantile bins a statistic.

    Without rows, or with one label only, the score is the same for all: the smoothed share of label 1.
    """
    n, inner = len(y), 2 ** DEPTH - 1
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    slot = binned + np.arange(width) * BINS
    margin = np.full(n, start)
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, wide = 2 ** depth - 1, 2 ** depth
            cell = ((node - first)[:, None] * width * BINS + slot).ravel()
            shape = (wide, width, BINS)
            g, h, c = (np.bincount(cell, np.repeat(v, width), wide * width * BINS).reshape(shape).cumsum(axis=2)
                       for v in (grad, hess, np.ones(n)))
            gl, hl, cl = g[..., :-1], h[..., :-1], c[..., :-1]
            gr, hr, cr = g[..., -1:] - gl, h[..., -1:] - hl, c[..., -1:] - cl
            gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - g[..., -1:] ** 2 / (h[..., -1:] + RIDGE)
            gain = np.where((cl >= LEAST_ROWS) & (cr >= LEAST_ROWS), gain, 0).reshape(wide, -1)
            best = gain.argmax(axis=1)
            split_bin = np.full(wide, BINS)
            for k in range(wide):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, best[k]] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k], split_bin[k] = f, edges[f][b], b
            local = node - first
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split_bin[local])
        g, h = (np.bincount(node - inner, v, inner + 1) for v in (grad, hess))
        leaf = RATE * g / (h + RIDGE)
        margin += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.stack(features), np.stack(cuts), np.stack(leaves), start)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are not learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learns from at most `sample_rows` labelled documents outside `held_out`, those with the least id hash.

    Labels other than 0 and 1 and null ids are left out; an id with both labels counts as 0.  An id that stands
    on several documents counts once.  Only the sample's statistics come to the driver.
    """
    total = labels.count()
    number = F.pmod(F.xxhash64("doc_id"), F.lit(10 ** 9))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    if total > 2 * sample_rows:         # held-out rows are a quarter; what is left over is cut below
        usable = usable.where(number < int(10 ** 9 * 2 * sample_rows / total) + 1)
    known = (usable.groupBy("doc_id").agg(F.min(label_col).alias("__y"), F.min(number).alias("__n"))
             .orderBy("__n", "doc_id").limit(sample_rows).select(F.col("doc_id").alias("__id"), "__y"))
    stats = F.pandas_udf(lambda texts: pd.Series(list(statistics(texts))), "array<double>")
    rows = (docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
            .join(F.broadcast(known), "__id")          # at most sample_rows pairs of numbers
            .select("__id", "__y", stats("__text").alias("__x"))
            .groupBy("__id", "__y").agg(F.min("__x").alias("__x")).orderBy("__id").toPandas())
    x = np.array(rows["__x"].tolist(), dtype=float).reshape(len(rows), len(STATISTICS))
    return train(x, rows["__y"].to_numpy(dtype=float))


def score(model: Trees, text_col: str = "text") -> Column:
    """The probability of label 1 of whole texts, a column to use in select() or where()."""
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(statistics(texts)))
    return F.pandas_udf(of, "double")(F.col(f"`{text_col}`"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Null texts score like empty ones; repeated rows score alike; an empty table gives an empty result; no
    column but the text enters a score.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return scored.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that are predicted to be good."""
    return docs.where(score(fit(docs, labels)) >= threshold)
