"""Vector expressions over arrays of doubles; all stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(x: Column) -> Column:
    """The components as doubles; null, NaN and infinite ones become 0."""
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")), 0.0).otherwise(v.cast("double")))


def let(x: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.transform(F.array(x), use)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """0 where either norm is at most `least`."""
    both = F.struct(norm(a).alias("a"), norm(b).alias("b"), dot(a, b).alias("dot"))
    return let(both, lambda n: F.when((n["a"] <= least) | (n["b"] <= least), 0.0).otherwise(n["dot"] / (n["a"] * n["b"])))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays. The norm is computed once, not once a component."""
    return let(a, lambda x: let(norm(x), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; an empty array stays empty."""

    def raised(y: Column) -> Column:
        return let(F.array_max(y), lambda m: F.transform(y, lambda v: F.exp((v - m) / temperature)))

    return let(let(x, raised), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: exp is taken of a value that is not positive."""

    def of(y: Column) -> Column:
        small = F.exp(-F.abs(y))
        return F.when(y >= 0, 1 / (1 + small)).otherwise(small / (1 + small))

    return let(x, of)


def hash_embedding(text: Column, width: int = 384) -> Column:
    """Counts of character trigrams of the lower-cased text between blanks, by crc32 modulo the width, at unit length.

    A text that is blank gives zeros. The trigrams of a batch of texts are hashed together, a byte at a time.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", ""), F.lit(" "))

    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([_trigram_counts(t, width) for t in texts])

    return F.pandas_udf(embed, T.ArrayType(T.DoubleType()))(padded)


def _trigram_counts(text: str, width: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    start = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
    if len(start) < 4:
        return np.zeros(width)
    first, size = start[:-3], start[3:] - start[:-3]
    crc = np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(int(size.max())):
        at = np.flatnonzero(size > i)
        crc[at] = _CRC[(crc[at] ^ data[first[at] + i]) & 0xFF] ^ (crc[at] >> np.uint32(8))
    counts = np.bincount((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(width), minlength=width).astype(np.float64)
    return counts / np.linalg.norm(counts)


def _crc_table() -> np.ndarray:
    """What each byte does to a crc32, by its rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()
