"""Clusters and the graph of labels. Grouped statistics are DataFrame aggregates; trees that grow are in trees.py."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.trees import GrowingTree, objective, risk_density, split_gate, two_means

__all__ = ["GrowingTree", "objective", "risk_density", "split_gate", "two_means"]
#: Vectors that may travel as one broadcast side.
MOST_VECTORS = 20_000


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """Adds cluster. Lloyd's rounds as grouped means from k-means|| starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    prepared = rows.withColumn("_features", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_features", predictionCol="cluster").fit(prepared)
    return model.transform(prepared).drop("_features")


def best_k(rows: DataFrame, vector: str, most: int, seed: int = 42) -> list[tuple[int, float]]:
    """(k, silhouette) for k from 2, by squared distances, best first, ties to the lesser k; labellings with fewer than k
    groups are left out."""
    found = [(k, s) for k in range(2, most + 1) if (s := silhouette_of(rows, vector, k, seed)) is not None]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def silhouette_of(rows: DataFrame, vector: str, k: int, seed: int = 42) -> float | None:
    """The silhouette of k-means with k groups; None if fewer come of it."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    labelled = kmeans(rows, vector, k, seed).withColumn("_f", array_to_vector(vector))
    if labelled.select("cluster").distinct().count() < k:
        return None
    return float(ClusteringEvaluator(featuresCol="_f", predictionCol="cluster").evaluate(labelled))


def peak_k(score: Callable[[int], float | None], start: int, step: int, most: int, patience: int) -> tuple[int, float]:
    """(k, score) of the best k among start, start + step and so on up to `most`; the search ends after `patience` of
    them in a row that are no better."""
    if start > most:
        raise ValueError(f"nothing to try: {start} is above {most}")
    best, missed = (start, -math.inf), 0
    for k in range(start, most + 1, step):
        found = score(k)
        if found is not None and found > best[1]:
            best, missed = (k, found), 0
        else:
            missed += 1
            if missed >= patience:
                break
    return best


def prune(nodes: list[tuple[str, str | None, int]], small: int = 5, leaf: int = 1) -> list[tuple[str, str | None, int]]:
    """(node, parent, own members) after pruning, from the leaves up.

    Children whose subtrees all hold fewer than `small` members are absorbed by their parent. Leaves of at most `leaf`
    members, and empty ones, go. A parent with one child left is replaced by it, whose members alone stay. Where nothing
    is left there is an empty root.
    """
    below: dict[str | None, list[str]] = {}
    own = {}
    for node, parent, n in nodes:
        below.setdefault(parent, []).append(node)
        own[node] = n

    def held(node: str) -> int:
        return own[node] + sum(held(c) for c in below.get(node, []))

    def absorb(node: str) -> None:
        for child in below.get(node, []):
            absorb(child)
        children = below.get(node, [])
        if children and all(held(c) < small for c in children):
            own[node] = held(node)
            below[node] = []

    def cut(node: str) -> str | None:
        below[node] = [c for c in map(cut, below.get(node, [])) if c is not None]
        if not below[node] and own[node] <= leaf:
            return None
        return below[node][0] if len(below[node]) == 1 else node

    out: list[tuple[str, str | None, int]] = []

    def emit(node: str, parent: str | None) -> None:
        out.append((node, parent, own[node]))
        for child in below[node]:
            emit(child, node)

    for root in below.get(None, []):
        absorb(root)
        kept = cut(root)
        if kept is None:
            out.append((root, None, 0))
        else:
            emit(kept, None)
    return out


def agglomerate(x: np.ndarray, linkage: str, threshold: float | None = None, k: int | None = None) -> list[int]:
    """Labels by first member of bottom-up merging of a bounded vocabulary: single, complete, average or ward linkage."""
    groups = [[i] for i in range(len(x))]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def between(a: list[int], b: list[int]) -> float:
        d = far[np.ix_(a, b)]
        if linkage == "ward":
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * float(np.linalg.norm(x[a].mean(axis=0) - x[b].mean(axis=0)))
        return float({"single": d.min, "complete": d.max, "average": d.mean}[linkage]())

    while len(groups) > (k or 1):
        d, i, j = min((between(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if threshold is not None and d > threshold:
            break
        groups[i] += groups.pop(j)
    labels = [0] * len(x)
    for g, members in enumerate(sorted(groups, key=min)):
        for i in members:
            labels[i] = g
    return labels


def stabilise(x: np.ndarray, labels: np.ndarray, target: np.ndarray, low: float, eps: float, close: float, rounds: int = 10) -> np.ndarray:
    """Split groups of low density (alignment over mean distance) and merge the closest pair of equal alignment, until
    neither happens."""
    labels = labels.copy()

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))

    for _ in range(rounds):
        changed = False
        for g in np.unique(labels).tolist():
            at = np.flatnonzero(labels == g)
            c = x[at].mean(axis=0)
            rho = max(0.0, min(1.0, cosine(c, target))) / (float(np.linalg.norm(x[at] - c, axis=1).mean()) + 1e-5)
            if rho < low and len(at) >= 2:
                labels[at[two_means(x[at]) == 1]] = labels.max() + 1
                changed = True
        groups = np.unique(labels).tolist()
        centers = {g: x[labels == g].mean(axis=0) for g in groups}
        aligned = {g: max(0.0, min(1.0, cosine(c, target))) for g, c in centers.items()}
        pairs = [(cosine(centers[a], centers[b]), a, b) for i, a in enumerate(groups) for b in groups[i + 1 :] if abs(aligned[a] - aligned[b]) < eps]
        if pairs and max(pairs)[0] > close:
            _, a, b = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
            labels[labels == b] = a
            changed = True
        if not changed:
            break
    return labels


def compact_name(child: str, parent: str) -> str:
    """The child's name without what it shares with its parent's beginning, if that is two words or more."""
    a, b = child.split(), parent.split()
    shared = 0
    while shared < min(len(a), len(b)) and a[shared].lower() == b[shared].lower():
        shared += 1
    return " ".join(a[shared:]) if shared >= 2 and shared < len(a) else child


def label_graph(vectors: DataFrame, name: str, vector: str, threshold: float, weight: float) -> DataFrame:
    """(src, dst, w): cosines from the threshold on, those between different labels times the weight, columns summing to 1.

    All pairs of a bounded vocabulary: one side is broadcast. With more than MOST_VECTORS it is an error.
    """
    from lodestone.functions.vectors import cosine

    n = vectors.count()
    if n > MOST_VECTORS:
        raise ValueError(f"{n} vectors do not fit a broadcast side")
    other = vectors.select(F.col(name).alias("dst"), F.col(vector).alias("y"))
    pairs = vectors.select(F.col(name).alias("src"), F.col(vector).alias("x")).join(F.broadcast(other), F.lit(True)).withColumn("s", cosine(F.col("x"), F.col("y"))).where(F.col("s") >= threshold)
    raw = pairs.select("src", "dst", F.when(F.col("src") == F.col("dst"), F.col("s")).otherwise(F.col("s") * weight).alias("w"))
    total = raw.groupBy("dst").agg(F.sum("w").alias("t"))
    return raw.join(total, "dst").select("src", "dst", (F.col("w") / F.when(F.col("t") <= 1e-12, 1.0).otherwise(F.col("t"))).alias("w"))


def dbscan(vectors: DataFrame, name: str, vector: str, eps: float, least: int = 1) -> DataFrame:
    """(node, root): DBSCAN of a bounded vocabulary by cosine distance; root is the least core member of the cluster.

    A core has `least` members or more within `eps`, itself among them. Cores that are near each other are one cluster;
    any other member near a core joins the cluster with the least root, and one near none stays alone.
    """
    from lodestone.functions.vectors import cosine

    n = vectors.count()
    if n > MOST_VECTORS:
        raise ValueError(f"{n} vectors do not fit a broadcast side")
    other = vectors.select(F.col(name).alias("b"), F.col(vector).alias("y"))
    near = vectors.select(F.col(name).alias("a"), F.col(vector).alias("x")).join(F.broadcast(other), F.lit(True)).where(1 - cosine(F.col("x"), F.col("y")) <= eps).select("a", "b")
    cores = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("node"))
    between = near.join(cores.withColumnRenamed("node", "a"), "a", "left_semi").join(cores.withColumnRenamed("node", "b"), "b", "left_semi")
    roots = graph.components(cores, between)
    border = near.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
    found = vectors.select(F.col(name).alias("node")).join(roots, "node", "left").join(border, "node", "left")
    return found.select("node", F.coalesce("root", "near", "node").alias("root"))
