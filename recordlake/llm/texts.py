"""Words of texts as numbers, for the operators on lines and passages."""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)                    # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(BASE), -1, 2 ** 64))

_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (n - 1) modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 1024), BASE, dtype=np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


def numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """The polynomial hash of every prefix; entry i is that of the first i words."""
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the spans of `length` words at `starts`, the same wherever they stand."""
    return (sums[starts + length] - sums[starts]) * inverse_powers(starts)


_INVERSE = np.ones(1, dtype=np.uint64)


def inverse_powers(at: np.ndarray) -> np.ndarray:
    global _INVERSE
    n = int(at.max(initial=0)) + 1
    if len(_INVERSE) < n:
        more = np.full(max(n, 1024), INVERSE, dtype=np.uint64)
        more[0] = 1
        _INVERSE = np.multiply.accumulate(more)
    return _INVERSE[at]


def mark(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A checksum that tells texts of the same id apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`"))


# ---- texts on the way through a shuffle ---------------------------------------------------------------------------

def packed(text: Column) -> Column:
    """The text compressed, so that a shuffle carries less."""
    def of(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        return pd.Series([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in texts])
    return F.pandas_udf(of, "binary")(text)


def unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)
