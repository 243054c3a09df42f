"""Fixed cases, properties, and edge cases of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import rouge, texts, vectors
from lodestone.operators import clusters, graph, ingest, models, scoring, selection


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_greedy_with_an_exact_tie(spark):
    rows = spark.createDataFrame([(0, {0: 4.0}), (1, {0: 3.0, 1: 1.0}), (2, {1: 2.0}), (3, {})], "position long, vector map<int,double>")
    found = selection.vector_greedy(rows, 4)
    assert [p for p, _ in found] == [1, 0, 2, 3]
    assert [round(g, 6) for _, g in found] == [2.079442, 0.693147, 0.693147, 0]


@pytest.mark.parametrize("page", [1, 3, 100])
def test_lazy_greedy_is_greedy(spark, page):
    rng = random.Random(page)
    data = [(i, {rng.randrange(6): float(rng.randrange(1, 9)) for _ in range(rng.randrange(4))}) for i in range(30)]
    totals, left, plain = {}, dict(data), []
    for _ in range(12):
        best = min(left, key=lambda i: (-round(selection.coverage_gain(left[i], totals), 12), -sum(left[i].values()), i))
        for k, x in left.pop(best).items():
            totals[k] = totals.get(k, 0.0) + x
        plain.append(best)
    rows = spark.createDataFrame(data, "position long, vector map<int,double>")
    assert [p for p, _ in selection.vector_greedy(rows, 12, page)] == plain


def test_diverse_sampling(spark):
    tags = {0: [1, 2], 1: [2, 3, 4], 2: [1], 3: [], 4: [3, 4]}
    rows = spark.createDataFrame([(k, list(map(str, v))) for k, v in tags.items()], "position long, tags array<string>")
    found = selection.diverse(rows, 5).orderBy("chosen").collect()
    assert [r["position"] for r in found] == [1, 0, 4, 2, 3]


def plain_diverse(tags, k):
    left, out = sorted(tags, key=lambda i: (-len(tags[i]), i)), []
    while len(out) < k and left:
        seen, before = set(), len(out)
        for i in list(left):
            if set(tags[i]) - seen:
                out.append(i)
                seen |= set(tags[i])
                left.remove(i)
                if len(out) == k:
                    return out
        if len(out) == before:
            break
    return out + left[: k - len(out)]


@pytest.mark.parametrize("most", [0, 1_000])
def test_diverse_rounds_match_a_scan(spark, most):
    rng = random.Random(5)
    tags = {i: sorted({str(rng.randrange(8)) for _ in range(rng.randrange(5))}) for i in range(25)}
    rows = spark.createDataFrame(list(tags.items()), "position long, tags array<string>")
    assert [r["position"] for r in selection.diverse(rows, 20, most).orderBy("chosen").collect()] == plain_diverse(tags, 20)


@pytest.mark.parametrize(("sizes", "budget", "expected"), [([5, 3, 2], 7, [4, 2, 1]), ([1, 1, 8], 5, [1, 0, 4]), ([2, 9], 11, [2, 9]), ([3], 0, [0])])
def test_hamilton(spark, sizes, budget, expected):
    frame = spark.createDataFrame(list(enumerate(sizes)), "g int, size long")
    assert [r["quota"] for r in selection.quotas(frame, "g", "size", budget).orderBy("g").collect()] == expected


def test_samples_have_exact_sizes_and_no_repeats(spark):
    rows = spark.createDataFrame([(i, "abc"[min(i // 40, 2)]) for i in range(100)], "id long, g string")
    plan = selection.uniform_quotas(rows.groupBy("g").agg(F.count("*").alias("size")), "g", "size", 70)
    ids = [r["id"] for r in selection.sample_by_quota(rows, "id", "g", plan, 70).collect()]
    assert len(ids) == len(set(ids)) == 70


def test_chunks(spark):
    found = selection.chunks(spark.range(10), 4, "id").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in found] == [3, 3, 3, 1]


def test_split_sizes(spark):
    assert selection.split(spark.range(9), "id", 0.05).where("is_test").count() == 1


def test_deviation_gain_dry_run(spark):
    scores = spark.createDataFrame([("a", 0, 0.8), ("b", 0, 0.4)], "id string, cap int, val double")
    found = {r["id"]: round(r["val"], 6) for r in scoring.deviation_gain(scoring.dry_run_losses(scores)).collect()}
    assert found == {"a": 0.689151, "b": 0.246573}


def test_gate_and_objective():
    p = np.array([[0, 0], [0, 1], [4, 0], [4, 1]], dtype=float)
    parent, child = clusters.risk_density(p), clusters.risk_density(p[:2])
    assert (parent, child) == (1.0625, 0.125)
    gate = clusters.split_gate(parent, [child, child], 5, 16, 5)
    assert round(gate["bias_gain"], 6) == 0.092131
    assert gate["accepted"]
    assert clusters.objective([p[:2], p[2:]]) == pytest.approx(24)


def test_multiplicative_update():
    metrics, rewards = [[1, 0, 0.5, 0.2], [0, 1, 0.5, 0.4]], [1, 0.5]
    u = [sum(m[i] * r for m, r in zip(metrics, rewards, strict=True)) / 2 for i in range(4)]
    assert [round(x, 6) for x in scoring.multiplicative_update([0.25] * 4, u, 0.8, 0.05)] == [0.28314, 0.234081, 0.257385, 0.225393]


def test_routing_softmax(spark):
    weights = one(spark, vectors.softmax(F.array(F.lit(0.9), F.lit(0.85), F.lit(0.8)), 0.1))
    assert [round(w, 6) for w in weights] == [0.50648, 0.307196, 0.186324]


def test_rouge():
    assert round(rouge.f1("the cat sat on mat", "the cat is on the mat"), 6) == 0.727273
    rng = random.Random(3)
    for _ in range(50):
        a, b = [[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert rouge.common_length(a, b) == t[-1][-1]


def test_expected_score(spark):
    assert round(one(spark, texts.expected_score([F.lit(x) for x in (-3.0, -2.5, -2.0, -1.0, -0.8, -1.5)])), 6) == 4.34165
    assert one(spark, texts.expected_score([F.lit(x).cast("double") for x in (-3.0, None, -2.0, -1.0, -0.8, -1.5)])) == 3.0


def test_batch_scores(spark):
    assert one(spark, texts.batch_scores(F.array(*[F.lit(x) for x in ("7", "4", "x", "2")]), F.lit(4))) == [4, 2, 3, 3]


@pytest.mark.parametrize(("reply", "expected"), [("Yes||fine", (True, 1.0, "fine")), ("no, wrong", (False, 0.0, "wrong")), ("", (False, 0.0, "")), (None, (False, 0.0, ""))])
def test_judge_reply(spark, reply, expected):
    assert tuple(one(spark, texts.judge_reply(F.lit(reply).cast("string")))) == expected


def test_hash_embedding(spark):
    import zlib

    assert zlib.crc32(b" ca") % 384 == 216
    found = one(spark, vectors.hash_embedding(F.lit("cat")))
    assert found[216] > 0
    assert math.isclose(sum(x * x for x in found), 1)
    assert sum(one(spark, vectors.hash_embedding(F.lit("  ")))) == 0


def test_prune_collapses_and_absorbs():
    nodes = [("r", None, 0), ("a", "r", 9), ("b", "r", 0), ("c", "b", 2), ("d", "b", 1)]
    assert clusters.prune(nodes) == [("r", None, 0), ("a", "r", 9), ("b", "r", 3)]
    assert clusters.prune([("r", None, 0)]) == [("r", None, 0)]


def test_components(spark):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (2, 1), (5, 6), (7, 6), (3, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5}


def test_conversations_without_parts(spark):
    turns = [(1, 0, "system", "s1"), (1, 1, "system", "s2"), (1, 2, "user", "u"), (1, 3, "assistant", "a"), (2, 0, "user", "u"), (3, 0, "system", "s"), (4, 0, "assistant", "x"), (4, 1, "user", " "), (5, 0, None, None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["instruction"], r["input"], r["output"], r["skip"]) for r in ingest.conversations_to_samples(rows).collect()}
    assert found[1] == ("u", "s1\n\ns2", "a", "kept")
    assert found[2][3] == "no_assistant_output"
    assert found[3][3] == found[4][3] == found[5][3] == "no_user_instruction"


@pytest.mark.parametrize(("reply", "expected"), [('{"relations": [{"rank": 1, "relation": "Strongly related"}]}', ["unrelated", "strongly related"]), ('["weak", "unrelated"]', ["weakly related", "unrelated"]), ("it is weakly related", ["weakly related", "unrelated"]), (None, ["unrelated"] * 2), ("{broken", ["unrelated"] * 2)])
def test_relations(reply, expected):
    assert models.relations(reply, 2) == expected


def test_softmax_weights_and_shares(spark):
    assert one(spark, scoring.shares(F.array(F.lit(-1.0), F.lit(0.0)))) == [0.5, 0.5]
    assert one(spark, scoring.shares(F.array(F.lit(3.0), F.lit(-1.0), F.lit(1.0)))) == [0.75, 0.0, 0.25]


def test_keep_mask_never_empties_a_batch(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 5.0)], "id long, g string, s double")
    kept = scoring.keep_mask(rows, "g", "s", "id", threshold=0.9).where("keep").collect()
    assert sorted(r["id"] for r in kept) == [1, 3]


def test_growing_tree_keeps_every_sample():
    rng = np.random.default_rng(4)
    tree = clusters.GrowingTree(0.8, size=10, scale=50.0, patience=15)
    for i, x in enumerate(rng.normal(size=(120, 6))):
        tree.add(i, x / np.linalg.norm(x))
    assert sorted(i for a in tree.leaves for i in a.ids) == list(range(120))
    assert [d[0] for d in tree.decisions if d[1] in ("add", "create")] == list(range(120))
    tree.rebalance()
    assert sorted(i for a in tree.leaves for i in a.ids) == list(range(120))
    assert all(a.ids for a in tree.leaves)


def test_two_means_never_leaves_a_side_empty():
    for x in (np.zeros((4, 2)), np.array([[0.0, 0], [0, 0], [5, 5]]), np.random.default_rng(1).normal(size=(30, 3))):
        assert set(clusters.two_means(x).tolist()) == {0, 1}


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_agglomeration(linkage):
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [50, 50]])
    assert clusters.agglomerate(x, linkage, k=3) == [0, 0, 1, 1, 2]
    assert clusters.agglomerate(x, linkage, threshold=3.0) == [0, 0, 1, 1, 2]


def test_compact_names():
    assert clusters.compact_name("Text Summary Of News", "text summary generation") == "Of News"
    assert clusters.compact_name("Text News", "Text Summary") == "Text News"
    assert clusters.compact_name("Text Summary", "Text Summary") == "Text Summary"


def test_vectors_of_zeros(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(zero, zero)) == 0
    assert one(spark, vectors.normalized(zero)) == [0, 0]
    assert one(spark, vectors.softmax(F.array().cast("array<double>"))) == []
    assert one(spark, vectors.doubles(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(1.5)))) == [0, 0, 1.5]
    assert one(spark, vectors.sigmoid(F.lit(-800.0))) == 0


def test_token_windows(spark):
    tokens = lambda *x: F.array(*[F.lit(t) for t in x]).cast("array<string>")
    assert one(spark, models.loss_window(tokens("a", "b", "c"), tokens("x", "y"), 4, F.lit("e"))) == ["b", "c", "x", "y"]
    assert one(spark, models.loss_window(tokens("a", "b"), tokens(), 4, F.lit("e"))) == ["a", "b", "e"]
    assert one(spark, models.loss_window(tokens("a"), tokens("x"), 2, F.lit("e"))) == ["x", "e"]
    sizes = F.array(*[F.lit(n).cast("long") for n in (5, 3, 4)])
    assert one(spark, models.demos_in_budget(tokens("p", "q", "r"), sizes, F.lit(2), 9)) == ["q", "r"]
    assert one(spark, models.demos_in_budget(tokens("p", "q", "r"), sizes, F.lit(20), 9)) == ["r"]
