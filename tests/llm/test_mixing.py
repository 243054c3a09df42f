from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing


@pytest.mark.parametrize(("target", "most"), [(0.9, 100.0), (0.5, 100.0), (0.99, 3.0), (0.1, 1.0), (1.0, 50.0)])
def test_bisection(target, most):
    tokens = {"a": 1000, "b": 100, "c": 100, "d": 10}
    e = mixing.solve(tokens, target, most)
    parts = mixing.weights(tokens, e)
    assert math.isclose(sum(parts.values()), 1)
    assert max(mixing.passes(tokens, parts).values()) <= most + 1e-6
    if max(mixing.passes(tokens, parts).values()) < most - 1e-3:
        assert mixing.entropy(parts) >= target - 1e-6
    if 0 < e < 1:  # a little more would break the entropy, or a little less the limit
        more, less = mixing.weights(tokens, e + 1e-6), mixing.weights(tokens, e - 1e-6)
        assert mixing.entropy(more) < target or max(mixing.passes(tokens, less).values()) > most


def plain(rows, most, rows_a_block, seed=17):
    """Copies by key, in Python."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sources = {}
    for k, s, n in rows:
        sources.setdefault(s, []).append((md5(f"{seed}:{k}"), max(0, n or 0), k))
    tokens = {s: sum(n for _, n, _ in v) for s, v in sources.items()}
    often = mixing.passes(tokens, mixing.weights(tokens, mixing.solve(tokens, 0.9, most)))
    out = {}
    for s, own in sources.items():
        whole = int(often[s] + 1e-9)
        rest = round(max(0.0, often[s] - whole) * tokens[s])
        blocks = {}
        for x in sorted(own):
            blocks.setdefault(int(x[0][:8], 16) % max(1, math.ceil(len(own) / rows_a_block)), []).append(x)
        for b in sorted(blocks, key=lambda b: (md5(f"{seed + 1}:{s}:{b}"), b)):
            full = sum(n for _, n, _ in blocks[b])
            left = rest
            for _, n, k in blocks[b]:
                rest_before = left
                take = full <= rest or (rest > 0 and n <= rest_before)
                left -= n
                out[k] = whole + int(take)
            rest -= full
    return out


@pytest.mark.parametrize("rows_a_block", [256, 8])
def test_copies(spark, rows_a_block):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", (i * 37) % 90 + 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("copies", F.lit("clash"))
    found = mixing.mix(frame, "source", F.col("n"), "doc_id", rows_a_block=rows_a_block).collect()
    assert {r["doc_id"]: r["copies"] for r in found} == plain(rows, 2.0, rows_a_block)
    assert all(1 <= r["copies"] <= 2 for r in found)


def test_shares_follow_the_weights(spark):
    rows = [(i, "big" if i < 1_500 else f"s{i % 5}", 10) for i in range(2_000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n long"), "source", F.col("n"), "doc_id", target_entropy=1.0, most_passes=3.0).collect()
    total = sum(r["copies"] for r in found)
    for s in ("big", "s0"):
        own = [r for r in found if r["source"] == s]
        assert sum(r["copies"] for r in own) / total == pytest.approx(own[0]["mix_weight"], abs=0.01)


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, None, None), (3, "a", -4), (4, "a", 0), (5, "b", 7), (5, "b", 7), (None, "b", 1)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n long"), "source", F.col("n"), "doc_id").collect()
    assert len(found) == len(rows)
    assert all(r["copies"] >= 1 for r in found)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, n long"), "source", F.col("n"), "doc_id").count() == 0
    alone = mixing.mix(spark.createDataFrame([(1, "a", 3)], "doc_id long, source string, n long"), "source", F.col("n"), "doc_id").first()
    assert (alone["mix_weight"], alone["copies"]) == (1.0, 1)


def test_blocks_by_shuffle_give_the_same(spark, monkeypatch):
    rows = [(i, f"s{i % 2 * (i % 5)}", i % 9) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n long")
    a = {r["doc_id"]: r["copies"] for r in mixing.mix(frame, "source", F.col("n"), "doc_id", rows_a_block=4).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert a == {r["doc_id"]: r["copies"] for r in mixing.mix(frame, "source", F.col("n"), "doc_id", rows_a_block=4).collect()}


def test_columns_of_any_name_survive(spark):
    names = ["_source", "_size", "_order", "_block", "_left", "_in", "row", "rest", "blocks", "order", "block", "left", "whole", "extra", "size", "key"]
    rows = [(i, f"s{i % 3}", 10, *names) for i in range(30)]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long, source string, n long", *(f"`{n}` string" for n in names)]))
    found = mixing.mix(frame, "source", F.col("n"), "doc_id", rows_a_block=4)
    assert found.columns == [*frame.columns, "mix_weight", "mix_passes", "copies"]
    assert all(list(r)[3:-3] == names for r in found.collect())
    assert found.count() == 30
