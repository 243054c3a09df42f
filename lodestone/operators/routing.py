"""Centroids and top-k routing of vectors to capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors

#: Centroids that may travel as one broadcast row of arrays.
MOST_CENTROIDS = 20_000


def centroids(members: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, c, n): the mean vector of each group, by position with partial sums."""
    by_place = members.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return by_place.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n"))


def route(rows: DataFrame, key: str, vector: str, targets: DataFrame, target: str, k: int = 3, temperature: float = 0.1) -> DataFrame:
    """(key, rank, capability, similarity, weight): the k nearest targets by cosine, their softmax over those k.

    The targets (target, c) become one row that is broadcast, so that rows are neither shuffled nor multiplied: the
    top k are found within each row. With more than MOST_CENTROIDS targets it is an error. Ties go to the lesser target.
    """
    n = targets.count()
    if n > MOST_CENTROIDS:
        raise ValueError(f"{n} centroids do not fit one broadcast row; route against a coarser level first")
    table = targets.agg(F.array_sort(F.collect_list(F.struct(F.col(target).alias("t"), vectors.normalized(F.col("c")).alias("c")))).alias("targets"))
    unit = rows.select(key, vectors.normalized(F.col(vector)).alias("v"))
    scored = F.transform("targets", lambda t: F.struct((-vectors.dot(F.col("v"), t["c"])).alias("minus"), t["t"].alias("t")))
    best = unit.join(F.broadcast(table)).select(key, F.slice(F.array_sort(scored), 1, k).alias("best"))
    weighed = best.withColumn("w", vectors.softmax(F.transform("best", lambda b: -b["minus"]), temperature))
    flat = weighed.select(key, F.posexplode(F.arrays_zip("best", "w")).alias("rank", "b"))
    return flat.select(key, F.col("rank").cast("int").alias("rank"), F.col("b.best.t").alias("capability"), (-F.col("b.best.minus")).alias("similarity"), F.col("b.w").alias("weight"))


def distance_to(members: DataFrame, group: str, vector: str, centers: DataFrame) -> DataFrame:
    """Members with their group's centre (c) and their distance to it (d). Few groups are broadcast, by their size."""
    joined = members.join(centers.select(group, "c"), group)
    return joined.withColumn("d", vectors.euclidean(F.col(vector), F.col("c")))


def risk(d: Column) -> Column:
    """Mean squared radius and its density: sum of squares over n, and over n again."""
    return F.struct((F.sum(d * d) / F.count("*")).alias("radius"), (F.sum(d * d) / F.count("*") / F.count("*")).alias("density"))
