"""Components of graphs and walks of trees, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b) in either direction; a node without edges is its own.

    Each round takes the least label among a node's neighbours, then its label's label; both are equi-joins over
    partial aggregates, and labels at most double their reach every round.
    """
    links = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).where("x <> y").distinct())
    labels = cut(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = links.join(labels.withColumnsRenamed({"node": "y", "root": "r"}), "y").groupBy(F.col("x").alias("node")).agg(F.min("r").alias("r"))
        hop = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"), F.col("root").alias("old"))
        jump = hop.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(hop.join(jump, "root").select("node", F.least("root", "far").alias("root"), "old"))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def walk(nodes: DataFrame) -> DataFrame:
    """(node, parent, depth, path): every node below the roots (null parents), a level at a time; path from the root."""
    level = cut(nodes.where("parent is null").select("node", "parent", F.lit(0).alias("depth"), F.array("node").alias("path")))
    found, depth = level, 0
    while level.limit(1).count():
        depth += 1
        above = level.select(F.col("node").alias("parent"), F.col("path").alias("up"))
        level = cut(nodes.join(above, "parent").select("node", "parent", F.lit(depth).alias("depth"), F.concat("up", F.array("node")).alias("path")))
        found = found.unionByName(level)
    return found


def closure(walked: DataFrame) -> DataFrame:
    """(ancestor, node, distance), a node being its own ancestor at distance 0: paths taken apart, without a join."""
    each = walked.select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return each.select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def parent_options(walked: DataFrame, sizes: DataFrame, candidates: DataFrame, asked: str, most: int = 12, hops: int = 4, top: int = 6) -> DataFrame:
    """(asked, node, rank): where new nodes may be founded, given candidates (asked, node) for each question.

    The root, the first nodes below it, and the candidates with their ancestors fewer than `hops` steps up; by depth,
    then by size (node, n), most first.
    """
    near = closure(walked).where(F.col("distance") < hops).join(candidates, "node").select(asked, F.col("ancestor").alias("node"))
    first = Window.partitionBy("parent").orderBy("node")
    broad = walked.where("depth = 0").select("node").unionByName(walked.where("depth = 1").withColumn("at", F.row_number().over(first)).where(F.col("at") <= top).select("node"))
    every = near.unionByName(candidates.select(asked).distinct().join(F.broadcast(broad)).select(asked, "node")).distinct()
    order = Window.partitionBy(asked).orderBy("depth", F.desc("n"), "node")
    ranked = every.join(walked.select("node", "depth"), "node").join(sizes, "node").withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= most).select(asked, "node", "rank")
