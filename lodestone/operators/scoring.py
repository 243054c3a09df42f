"""Scorers and adaptive weights. Model outputs come as columns; everything else is column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors


def gate(relation: Column, weak: float = 0.1) -> Column:
    """1 for strong relations, `weak` for weak ones, else 0."""
    return F.when(relation.contains("strong"), 1.0).when(relation.contains("weak"), weak).otherwise(0.0)


def late_fusion(routed: DataFrame, weak: float = 0.1) -> DataFrame:
    """(id, cap, val) of rows (id, cap, score, relation): gated similarities summed by capability."""
    return routed.groupBy("id", "cap").agg(F.sum(F.col("score") * gate(F.col("relation"), weak)).alias("val"))


def deviation_gain(losses: DataFrame, threshold: float = 3.0, smoothness: float = 1.0, least_std: float = 1e-6) -> DataFrame:
    """(id, cap, val) of rows (id, cap, base, cond): the standardised fall of the loss, damped where the loss stays high.

    Mean and population deviation are of all rows of a capability: two small aggregates, joined back.
    """
    d = losses.withColumn("dev", F.col("base") - F.col("cond"))
    stats = d.groupBy("cap").agg(F.avg("dev").alias("mu"), F.greatest(F.stddev_pop("dev"), F.lit(least_std)).alias("sd"))
    gain = vectors.sigmoid((F.col("dev") - F.col("mu")) / F.col("sd"))
    penalty = 1 - vectors.sigmoid((F.col("cond") - threshold) / max(smoothness, 1e-8))
    return d.join(stats, "cap").select("id", "cap", F.greatest(F.lit(0.0), gain * penalty).alias("val"))


def dry_run_losses(scores: DataFrame) -> DataFrame:
    """(id, cap, base, cond) without a model: base 1, cond what a score (id, cap, val) leaves of it."""
    return scores.select("id", "cap", F.lit(1.0).alias("base"), F.greatest(F.lit(0.0), 1 - F.col("val")).alias("cond"))


def active(scores: Column, routed: Column, mode: str, most: int = 5) -> Column:
    """Capabilities in use: of scores (array of cap, val) by value, of the routing, or both; at most `most`."""
    by_value = F.transform(F.array_sort(F.transform(scores, lambda s: F.struct((-s["val"]).alias("m"), s["cap"].alias("cap")))), lambda s: s["cap"])
    known = F.filter(routed, lambda c: c >= 0)
    chosen = {"scored": by_value, "topk": known}.get(mode, F.array_distinct(F.concat(by_value, known)))
    return F.slice(chosen, 1, most) if most > 0 else chosen


def shares(weights: Column, uniform: bool = False) -> Column:
    """Weights clipped at 0 with sum 1; equal ones if asked for or if nothing is positive."""
    equal = F.transform(weights, lambda w: 1.0 / F.size(weights))
    if uniform:
        return equal
    clipped = F.transform(weights, lambda w: F.greatest(F.lit(0.0), w))
    return vectors.let(clipped, lambda c: vectors.let(vectors.total(c), lambda t: F.when(t > 0, F.transform(c, lambda w: w / t)).otherwise(equal)))


def spread(scalar: Column, weights: Column, uniform: bool = False) -> Column:
    """A scalar over routed capabilities by their shares."""
    return F.transform(shares(weights, uniform), lambda w: w * scalar)


def four_metric(x: Column, eps: float = 0.01) -> Column:
    """From 0..5 to eps..1 - eps."""
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), x)) / 5 * (1 - 2 * eps) + eps


def recipe_score(utility: DataFrame, alpha: list[float], data_weight: float, reward_weight: float) -> DataFrame:
    """(id, score) of rows (id, u: array of methods' utilities, reward in -1..1)."""
    weights = F.array(*[F.lit(a / max(sum(alpha), 1e-12)) for a in alpha])
    return utility.select("id", (data_weight * vectors.dot(F.col("u"), weights) + reward_weight * (F.col("reward") + 1) / 2).alias("score"))


def keep_mask(rows: DataFrame, group: str, score: str, position: str, threshold: float = 0.5) -> DataFrame:
    """Adds keep: the sigmoid of the standardised score within its batch; a batch that keeps none keeps its best."""
    w = Window.partitionBy(group)
    probability = vectors.sigmoid((F.col(score) - F.avg(score).over(w)) / F.greatest(F.stddev_pop(score).over(w), F.lit(1e-6)))
    marked = rows.withColumn("_keep", probability >= threshold)
    best = F.row_number().over(w.orderBy(F.desc(score), position)) == 1
    return marked.withColumn("keep", F.col("_keep") | (~F.bool_or("_keep").over(w) & best)).drop("_keep")


def normalized_weights(x: list[float], n: int) -> list[float]:
    """Clipped at 0, cut or filled to n entries, sum 1; equal ones if nothing is positive."""
    y = [max(0.0, float(v)) for v in x[:n]] + [0.0] * (n - len(x))
    total = sum(y)
    return [v / total for v in y] if total > 0 else [1.0 / n] * n


def softmax(x: list[float]) -> list[float]:
    top = max(x)
    e = [math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


@dataclass
class AlphaState:
    """Method weights that follow reward: a few numbers that a driver carries from batch to batch."""

    alpha: list[float]
    utility: list[float] = field(default_factory=list)
    reward_mean: float = 0.0
    reward_var: float = 1.0
    rate: float = 0.5
    temperature: float = 1.0
    signal_momentum: float = 0.1
    reward_momentum: float = 0.1
    step: float = 0.5
    floor: float = 0.05

    def update(self, signal: list[float], reward: float) -> list[float]:
        """signal: mean over the batch of each method's z-score within its row; reward: the batch's mean, in 0..1."""
        n, m = len(self.alpha), self.reward_momentum
        self.reward_mean = (1 - m) * self.reward_mean + m * reward
        self.reward_var = max((1 - m) * self.reward_var + m * (reward - self.reward_mean) ** 2, 1e-8)
        advantage = (reward - self.reward_mean) / max(math.sqrt(self.reward_var), 1e-6)
        old = self.utility or [0.0] * n
        self.utility = [(1 - self.signal_momentum) * u + self.signal_momentum * s * advantage for u, s in zip(old, signal, strict=True)]
        target = softmax([math.log(max(a, 1e-12)) + self.rate * u / self.temperature for a, u in zip(self.alpha, self.utility, strict=True)])
        floor = min(self.floor, 0.99 / n)
        target = [t * (1 - floor * n) + floor for t in target]
        mixed = [max((1 - self.step) * a + self.step * t / sum(target), 1e-12) for a, t in zip(self.alpha, target, strict=True)]
        self.alpha = [a / sum(mixed) for a in mixed]
        return self.alpha


def method_signal(utility: DataFrame) -> tuple[list[float], float]:
    """For a batch (u: array, reward): the mean z-score of each method and the mean scaled reward. One row comes back."""
    mean = vectors.total(F.col("u")) / F.size("u")
    std = F.greatest(F.sqrt(vectors.total(F.transform("u", lambda x: (x - F.col("m")) * (x - F.col("m")))) / F.size("u")), F.lit(1e-6))
    z = utility.withColumn("m", mean).withColumn("s", std).select(F.posexplode(F.transform("u", lambda x: (x - F.col("m")) / F.col("s"))).alias("i", "z"), "reward")
    rows = z.groupBy("i").agg(F.avg("z").alias("z"), F.avg((F.col("reward") + 1) / 2).alias("r")).orderBy("i").collect()
    return [r["z"] for r in rows], rows[0]["r"] if rows else 0.5


def multiplicative_update(alpha: list[float], utilities: list[float], rate: float, eps: float) -> list[float]:
    """alpha * exp(rate * utility), normalised, mixed with equal weights."""
    raised = [a * math.exp(rate * u) for a, u in zip(alpha, utilities, strict=True)]
    return [(1 - eps) * r / max(sum(raised), 1e-12) + eps / len(alpha) for r in raised]


def utilities(batch: DataFrame) -> list[float]:
    """Means of reward * metric over a batch (metrics: array, reward)."""
    rows = batch.select(F.posexplode("metrics").alias("i", "m"), "reward").groupBy("i").agg(F.avg(F.col("m") * F.col("reward")).alias("u")).orderBy("i").collect()
    return [r["u"] for r in rows]


def anchor_reward(samples: DataFrame, anchors: DataFrame, beta: DataFrame) -> DataFrame:
    """(id, reward): mean similarity of a row's unit vector to its capabilities' anchors, weighted by beta; 0 without any.

    samples: id, v, caps (array); anchors: cap, g; beta: cap, w. Anchors are as few as capabilities.
    """
    table = anchors.join(beta, "cap").where("w > 0").select("cap", vectors.normalized(F.col("g")).alias("g"), "w")
    each = samples.select("id", vectors.normalized(F.col("v")).alias("v"), F.explode("caps").alias("cap")).join(table, "cap")
    found = each.groupBy("id").agg((F.sum(F.col("w") * vectors.dot(F.col("v"), F.col("g"))) / F.sum("w")).alias("reward"))
    return samples.select("id").join(found, "id", "left").select("id", F.coalesce("reward", F.lit(0.0)).alias("reward"))
