from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk_search


def plain(rows, k=5):
    codes = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(codes):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(codes[q], codes[c], strict=False)), c) for c in codes if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return out


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    return sorted(tuple(r) for r in topk_search.search(frame, F.col("vec_id") % 50 == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block", [4_096, 40])
def test_against_all_pairs(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(260)]  # many ties
    assert found(spark, rows, block=block, query_block=2) == plain(rows)


def test_edge_cases(spark):
    rows = [(0, [0.1, 0.2]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [0.5, -0.5]), (50, []), (100, [1.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []
    assert found(spark, [(0, [1e12, 1e12]), (1, [3.0, 1.0]), (2, [1.0, 3.5])]) == plain([(0, [float(np.float32(1e12))] * 2), (1, [3.0, 1.0]), (2, [1.0, 3.5])])


def test_copies_of_one_vector(spark):
    rows = [(i, [0.5] * 8) for i in range(300)]
    assert found(spark, rows, block=64) == plain(rows)


@pytest.mark.parametrize("shape", ["normal", "skewed", "clustered"])
def test_bounds_keep_the_best_and_drop_others(shape):
    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(size=(2_000, 16)), "skewed": rng.exponential(size=(2_000, 16)) ** 3, "clustered": rng.normal(size=(2_000, 16)) * 0.1 + rng.normal(size=(10, 16))[rng.integers(0, 10, 2_000)]}[shape]
    x = np.floor(x * 256)
    q = x[:20]
    exclude = np.zeros((20, 2_000), dtype=bool)
    kept = topk_search.no_random_access(x, q, 5, exclude)
    for i, at in enumerate(kept):
        scores = x @ q[i]
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(at.tolist())
    assert np.mean([len(a) for a in kept]) < 1_000
