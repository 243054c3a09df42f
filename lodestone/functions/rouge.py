"""ROUGE-L by longest common subsequence, in Arrow batches: a recurrence over cells that no built-in expresses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TOKEN = re.compile(r"[一-鿿]|[a-z0-9_]+")


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each place of the shorter list."""
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, token in enumerate(b):
        at[token] = at.get(token, 0) | 1 << i
    row = (1 << len(b)) - 1
    full = row
    for token in a:
        hit = row & at.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def f1(prediction: str | None, gold: str | None) -> float:
    a, b = _TOKEN.findall((prediction or "").lower()), _TOKEN.findall((gold or "").lower())
    if not a or not b:
        return float(not a and not b)
    n = common_length(a, b)
    return 2 * n / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def rouge_l_f1(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([f1(p, g) for p, g in zip(prediction, gold, strict=True)], dtype="float64")
