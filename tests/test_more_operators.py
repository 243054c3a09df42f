"""Operators that SQL cannot check, against plain loops."""

from __future__ import annotations

import collections
import functools
import json
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import texts, vectors
from lodestone.operators import clusters, models, scoring, selection
from lodestone.plans import registry
from lodestone.sources import files
from lodestone.streaming import recipe

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def plain_embedding(text, width):
    padded = f" {text.strip().lower()} "
    out = [0.0] * width
    for i in range(len(padded) - 2):
        out[zlib.crc32(padded[i : i + 3].encode()) % width] += 1
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def test_hash_embedding_of_whole_texts(spark):
    rows = [(1, "Some Words, and é😀 more"), (2, ""), (3, None), (4, "a"), (5, "日本語 text " * 500)]
    found = spark.createDataFrame(rows, "id long, t string").select("id", vectors.hash_embedding(F.col("t"), 48).alias("e")).collect()
    for r, (_, t) in zip(sorted(found), rows, strict=True):
        assert r["e"] == pytest.approx(plain_embedding(t or "", 48) if (t or "").strip() else [0.0] * 48)


def test_x6_covers_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = registry.queries()["x6_hash_embedding"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found[:40]:
        assert r["embedding"] == pytest.approx(plain_embedding(docs[r["doc_id"]] or "", 384), abs=1e-6)


def test_x7_tf_idf(spark):
    """Weights by a loop over the same places."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.transform(texts.words(F.coalesce("text", F.lit(""))), lambda w: F.pmod(F.hash(w), F.lit(256))).alias("places")).collect()
    df = collections.Counter(p for r in docs for p in set(r["places"]))
    wanted = {}
    for r in docs:
        tf = collections.Counter(r["places"])
        if tf:
            weight, place = max((n * (math.log((len(docs) + 1) / (df[p] + 1)) + 1), p) for p, n in tf.items())
            wanted[r["doc_id"]] = (place, round(weight, 6))
    found = {r["doc_id"]: (r["place"], r["weight"]) for r in registry.queries()["x7_tf_idf_hashing"](spark, SF).collect()}
    assert set(found) == set(wanted)
    assert all(found[k][1] == pytest.approx(wanted[k][1], abs=2e-6) for k in wanted)


def plain_mig(data, k, slope):
    totals, left, out = {}, dict(data), []
    for _ in range(k):
        gain = lambda v, totals=totals: sum(x * slope(totals.get(i, 0.0)) for i, x in sorted(v.items()))
        best = min(left, key=lambda i: (-round(gain(left[i]), 12), -round(sum(left[i].values()), 12), i))
        out.append((best, round(gain(left[best]), 9)))
        for i, x in left.pop(best).items():
            totals[i] = totals.get(i, 0.0) + x
    return out


@pytest.mark.parametrize("phi", ["pow", "exp"])
def test_information_gain(spark, phi):
    rng = random.Random(4)
    data = [(i, {rng.randrange(6): float(rng.randrange(1, 9)) / 4 for _ in range(rng.randrange(4))}) for i in range(30)]
    slope = (lambda t: 0.8 * (t + 1.0) ** -0.2) if phi == "pow" else (lambda t: 0.5 * math.exp(-0.5 * t))
    rows = spark.createDataFrame(data, "position long, vector map<int,double>")
    found = selection.mig_greedy(rows, 12, 5, phi=phi, alpha=0.5)
    assert [(p, round(g, 9)) for p, g in found] == plain_mig(data, 12, slope)
    with pytest.raises(ValueError):
        selection.mig_greedy(rows, 1, phi="log")


def test_greedy_without_pages_on_the_driver(spark):
    """First gains that are all alike: the driver may hold four rows, the rest is chosen by aggregates."""
    data = [(i, {i % 5: 1.0, 7: 0.0}) for i in range(20)]
    rows = spark.createDataFrame(data, "position long, vector map<int,double>")
    few, all_ = selection.vector_greedy(rows, 9, 2, most=4), selection.vector_greedy(rows, 9, 100)
    assert [(p, round(g, 9)) for p, g in few] == [(p, round(g, 9)) for p, g in all_]


def sent(spark, run):
    """Bytes of task results that a call brings to the driver."""
    spark.sparkContext.setJobGroup(name := f"sent-{random.random()}", "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup(name) for i in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(i).resultSize() for i in stages)


@pytest.mark.parametrize("greedy", [selection.vector_greedy, selection.mig_greedy, functools.partial(selection.mig_greedy, phi="exp", alpha=0.5)])
def test_greedy_sends_the_driver_no_more_of_larger_tables(spark, greedy):
    """Gains that are all alike: every row could win, but the driver gets a page a choice at most."""
    def run(n):
        w = (F.col("id") % 89 + 1) / 100
        rows = spark.range(0, n, 1, 8).select(F.col("id").alias("position"), F.create_map((F.col("id") % 5).cast("int"), w, F.lit(7), 1 - w).alias("vector"))
        return sent(spark, lambda: greedy(rows, 4, 100))

    assert run(8_000) < 2 * run(2_000)


def test_first_rows_over_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(i, (i * 7) % 13 if i % 5 else None) for i in range(60)], "id long, s long")
    few = selection.scalar_topk(rows, "s", "id", 25).orderBy("selection_rank").collect()
    monkeypatch.setattr(selection, "MOST_SORTED", 3)
    assert selection.scalar_topk(rows, "s", "id", 25).orderBy("selection_rank").collect() == few
    assert [r["selection_rank"] for r in few] == list(range(1, 26))
    assert selection.simple_sample(rows, "id", 10).count() == 10
    assert selection.scalar_topk(rows.withColumnRenamed("id", "position"), "s", "position", 4).columns == ["position", "s", "selection_rank"]


def plain_dbscan(far, eps, least):
    near = [[j for j in range(len(far)) if far[i][j] <= eps] for i in range(len(far))]
    cores = [i for i in range(len(far)) if len(near[i]) >= least]
    root = {i: i for i in cores}
    changed = True
    while changed:
        changed = False
        for i in cores:
            low = min([root[i], *(root[j] for j in near[i] if j in root)])
            changed |= low < root[i]
            root[i] = low
    return {i: root[i] if i in root else min((root[j] for j in near[i] if j in root), default=i) for i in range(len(far))}


@pytest.mark.parametrize(("eps", "least"), [(0.02, 1), (0.05, 3), (0.2, 4), (2.0, 2), (0.0, 2)])
def test_dbscan(spark, eps, least):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "name int, v array<double>")
    found = {r["node"]: r["root"] for r in clusters.dbscan(rows, "name", "v", eps, least).collect()}
    assert found == plain_dbscan(np.round(1 - unit @ unit.T, 14), eps, least)


def test_peak_search_steps_and_stops():
    tried = []

    def score(k):
        tried.append(k)
        return {2: 0.1, 4: 0.5, 6: 0.4, 8: None, 10: 0.9}[k]

    assert clusters.peak_k(score, 2, 2, 10, 2) == (4, 0.5)
    assert tried == [2, 4, 6, 8]
    assert clusters.peak_k(score, 2, 2, 10, 3) == (10, 0.9)
    with pytest.raises(ValueError):
        clusters.peak_k(score, 5, 1, 4, 1)


def test_kmeans_of_groups_that_are_apart(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, (rng.normal(size=3) * 0.1 + 10 * (i % 3)).tolist()) for i in range(60)], "id long, v array<double>")
    labels = {r["id"]: r["cluster"] for r in clusters.kmeans(rows, "v", 3).collect()}
    assert all(labels[i] == labels[i % 3] for i in labels)
    assert len({labels[i] for i in range(3)}) == 3
    assert clusters.best_k(rows, "v", 5)[0][0] == 3
    alike = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "id long, v array<double>")
    assert clusters.silhouette_of(alike, "v", 3) is None


def test_o14_takes_equal_shares_of_clusters(spark):
    chosen = registry.queries()["o14_kmeans_sample"](spark, SF).collect()
    sizes = collections.Counter(r["cluster"] for r in registry.queries()["c1_kmeans"](spark, SF).collect())
    taken = collections.Counter(r["cluster"] for r in chosen)
    assert len({r["vec_id"] for r in chosen}) == len(chosen) == 100
    assert all(taken[c] >= min(n, 12) for c, n in sizes.items())


def test_attention_weights(spark):
    rng = np.random.default_rng(1)
    a = rng.random((3, 5, 5))
    column = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in head]) for head in a])
    span = lambda s, e: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"))
    found = one(spark, models.attention_weights(column, span(3, 5), F.array(span(0, 2), span(2, 3), span(4, 4), span(1, 99))))
    w = [a[:, 3:5, 0:2].mean(), a[:, 3:5, 2:3].mean(), 0.0, a[:, 3:5, 1:].mean()]
    assert found == pytest.approx([x / sum(w) for x in w])
    assert one(spark, models.attention_weights(column, span(3, 3), F.array(span(0, 2), span(2, 3)))) == [0.5, 0.5]


def test_scorers_by_language(spark):
    rows = spark.createDataFrame([(1, "a b c", "a b d"), (2, "中文", "中文"), (3, None, "x"), (4, "x", None)], "id long, p string, r string")
    zh = lambda p, r: pd.Series([9.0] * len(p))
    found = {r["id"]: (r["language"], r["score"]) for r in models.score_pairs(rows, "p", "r", {"zh": zh}).collect()}
    assert found[1] == ("en", pytest.approx(2 / 3))
    assert found[2] == ("zh", 9.0)
    assert found[3] == found[4] == ("en", 0.0)


def test_response_loss_masks_the_prompt(spark):
    rows = spark.createDataFrame([(1, "p q", "a bb"), (2, "p", ""), (3, None, "ccc")], "id long, p string, r string")
    found = {r["id"]: r["loss"] for r in models.response_loss(rows, "p", "r", lambda t: [float(len(x)) + 10 * i for i, x in enumerate(t)]).collect()}
    assert found == {1: pytest.approx(((1 + 20) + (2 + 30)) / 2), 2: None, 3: 3.0}


def test_compact_names_as_columns(spark):
    for child, parent in [("Text Summary Of News", "text summary generation"), ("Text News", "Text Summary"), ("Text Summary", "Text Summary"), ("A b  c d", "a B x")]:
        assert one(spark, texts.compact_name(F.lit(child), F.lit(parent))) == clusters.compact_name(child, parent)


def test_alpha_follows_reward(spark):
    """Updates by a loop over the same batches."""
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v").collect()]
    state, wanted = scoring.AlphaState([0.25] * 4), []
    for batch in range(4):
        z, rewards = [], []
        for r in rows:
            if r["vec_id"] % 4 == batch:
                u = np.array(r["v"][:4])
                z.append((u - u.mean()) / max(u.std(), 1e-6))
                rewards.append((r["v"][4] + 1) / 2)
        state.update(np.mean(z, axis=0).tolist(), float(np.mean(rewards)))
        wanted += [round(a, 5) for a in state.alpha]
    found = registry.queries()["u10_alpha_updates"](spark, SF).orderBy("batch", "method").collect()
    assert [round(r["alpha"], 5) for r in found] == pytest.approx(wanted, abs=2e-5)
    assert sum(state.alpha) == pytest.approx(1)


def test_recipe_goes_on_where_it_stopped(spark, tmp_path):
    """A second run over more files starts from the state that the first one left, and counts no batch twice."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "u array<double>, reward double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    batches = [[([0.1, 0.9, 0.3], 0.5)], [([0.7, 0.2, 0.4], -0.2)], [([0.6, 0.6, 0.1], 0.9)]]
    plain = scoring.AlphaState([1 / 3] * 3)
    seen = []
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").json(source)
        plain.update(*scoring.method_signal(frame))
        fresh = recipe.run_recipe(stream(), scoring.AlphaState([1 / 3] * 3), check, lambda n, a: seen.append(n))
        assert fresh.alpha == pytest.approx(plain.alpha)
    assert seen == [0, 1, 2]


def test_capability_width_and_trees_from_files(spark, tmp_path):
    rows = lambda *index: spark.createDataFrame([(i, f"n{i}", None) for i in index], "order int, node_id string, capability_name string")
    assert [files.capabilities(rows(*x))[1] for x in ((), (0,), (0, 4))] == [0, 1, 5]
    tree = {"root": {"node_id": "r", "center_vector": [0.0], "data_count": 9, "children": [
        {"node_id": "a", "center_vector": [1.0], "data_count": 5, "children": [{"node_id": "c", "leaf_center_vector": [3.0], "data_ids": ["x", "y"]}, {"node_id": "d", "leaf_center_vector": [4.0], "data_ids": ["z"]}]},
        {"node_id": "b", "leaf_center_vector": [2.0], "data_ids": []}]}}
    path = tmp_path / "tree.json"
    path.write_text(json.dumps(tree))
    read = lambda **how: [(r["node_id"], r["c"]) for r in files.read_tree_centroids(spark, str(path), **how).collect()]
    assert read() == [("c", [3.0]), ("d", [4.0])]
    assert read(least=2) == [("c", [3.0])]
    assert read(scope="all") == [("a", [1.0]), ("c", [3.0]), ("d", [4.0])]
    assert files.read_centroids(spark, str(path)).count() == 2
