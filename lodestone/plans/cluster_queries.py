"""Queries of clusters and trees (C, A21, K10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import texts, vectors
from lodestone.operators import clusters, graph, routing, trees
from lodestone.plans.registry import register
from lodestone.plans.relational_queries import _DIST, _distances
from lodestone.sources.tables import CENTROIDS_SQL, table
from lodestone.sources.tables import vectors as read_vectors

_TREE = "t AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'root' FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation), m AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS node, c_custkey AS id FROM customer)"
_WALK = "w AS (SELECT node, parent, 0 AS depth, [node] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, w.depth + 1, list_append(w.path, t.node) FROM t JOIN w ON t.parent = w.node)"


def _tree(spark, folder):
    """Regions and nations as a tree of three levels, customers as members of its leaves."""
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    regions = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    nations = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    members = table(spark, folder, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("node"), F.col("c_custkey").alias("id"))
    return root.unionByName(regions).unionByName(nations), members


def _numbered(tree):
    return [(i, int(k), what, leaf) for i, (k, what, leaf) in enumerate(tree.decisions)]


_DECISIONS = "step int, vec_id long, decision string, node string"


def _grown(spark, folder, make, tell, schema, **how):
    """What is told of the trees that all vectors grow, part by part."""
    return trees.grow(read_vectors(spark, folder), "vec_id", "v", make, tell, schema, **how)


@register("c1_kmeans")
def kmeans(spark, folder):
    return clusters.kmeans(read_vectors(spark, folder), "v", 8).select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@register("c2_best_k")
def best_k(spark, folder):
    return spark.createDataFrame([(k, round(s, 6)) for k, s in clusters.best_k(read_vectors(spark, folder), "v", 4)], "k int, silhouette double")


@register("c3_split_gate", f"WITH {_DIST}, r AS (SELECT label, sum(d * d) / count(*) / count(*) AS r FROM d GROUP BY label) SELECT a.label AS parent, b.label AS child, (b.r - a.r) < 5 * (power(10, -2.0 / 64) - power(11, -2.0 / 64)) AS accepted FROM r a JOIN r b ON b.label = (a.label + 1) % 10")
def split_gate(spark, folder):
    """The gate's arithmetic over grouped risk densities: each label against the next."""
    r = _distances(spark, folder).groupBy("label").agg(routing.risk(F.col("d"))["density"].alias("r"))
    other = r.select(F.col("label").alias("child"), F.col("r").alias("q"))
    gain = 5 * (F.pow(F.lit(10.0), F.lit(-2.0 / 64)) - F.pow(F.lit(11.0), F.lit(-2.0 / 64)))
    return r.join(other, F.col("child") == (F.col("label") + 1) % 10).select(F.col("label").alias("parent"), F.col("child").cast("int").alias("child"), (F.col("q") - F.col("r") < gain).alias("accepted"))


@register("c4_incremental")
def incremental(spark, folder):
    """Add, create and split decisions for all samples; split by the gate. Every seventh comes with a router's reply."""
    rows = read_vectors(spark, folder).withColumn("reply", F.when(F.col("vec_id") % 7 == 0, "new:root").when(F.col("vec_id") % 7 == 1, "leaf0"))
    return trees.grow(rows, "vec_id", "v", lambda: trees.GrowingTree(1.1, scale=5.0), _numbered, _DECISIONS, reply="reply")


@register("c5_warm_tree")
def warm_tree(spark, folder):
    """Trees whose first fifty samples are leaves by k-means."""
    return _grown(spark, folder, lambda: trees.GrowingTree(1.1, scale=5.0), _numbered, _DECISIONS, warm=50)


@register("c5_warm_start")
def warm_start(spark, folder):
    """k-means of the first fifty samples with the best silhouette."""
    first = read_vectors(spark, folder).orderBy("vec_id").limit(50)
    k = clusters.best_k(first, "v", 4)[0][0]
    return clusters.kmeans(first, "v", k).select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@register("c6_stale_leaves")
def stale_leaves(spark, folder):
    """Leaves of one sample that saw no other for forty samples, as they go."""
    rows = read_vectors(spark, folder).withColumn("reply", F.when(F.col("vec_id") % 11 == 0, "new:root"))
    grown = trees.grow(rows, "vec_id", "v", lambda: trees.GrowingTree(0.9, patience=40), _numbered, _DECISIONS, reply="reply")
    return grown.where("decision = 'prune'")


@register("c7_nearest_leaf", f"WITH {CENTROIDS_SQL} SELECT vec_id, arg_min(c.label, (round(list_distance(v, c.c), 9), c.label)) AS leaf FROM e CROSS JOIN c GROUP BY vec_id")
def nearest_leaf(spark, folder):
    v = read_vectors(spark, folder)
    leaves = routing.centroids(v, "label", "v").agg(F.collect_list(F.struct("label", "c")).alias("leaves"))
    near = F.array_min(F.transform("leaves", lambda t: F.struct(F.round(vectors.euclidean(F.col("v"), t["c"]), 9).alias("d"), t["label"].alias("label"))))
    return v.join(F.broadcast(leaves)).select("vec_id", near["label"].alias("leaf"))


@register("c8_objective_split")
def objective_split(spark, folder):
    """Splits where the objective gains by them."""
    return _grown(spark, folder, lambda: trees.GrowingTree(1.1, gate=False), _numbered, _DECISIONS)


@register("c9_hierarchy")
def hierarchy(spark, folder):
    """The nodes of hierarchies of three levels."""
    return _grown(spark, folder, lambda: trees.LayeredTree(1.4, layers=4), lambda tree: [(n, p, d, own, below, round(r, 6)) for n, p, d, own, below, r in tree.rows()], "node string, parent string, depth int, own int, below int, reach double")


def _rebalanced(tree):
    tree.rebalance()
    return [(node, int(i)) for node, _, i in tree.members()]


@register("c10_rebalance")
def rebalance(spark, folder):
    return _grown(spark, folder, lambda: trees.GrowingTree(1.0), _rebalanced, "node string, vec_id long")


@register("c11_two_means")
def two_means(spark, folder):
    """The two sides of every part."""
    sides = lambda frame: list(zip(frame["vec_id"].tolist(), trees.two_means(trees.matrix(frame["v"])).tolist(), strict=True))
    return trees.in_parts(read_vectors(spark, folder), "vec_id", ["v"], sides, "vec_id long, side int")


@register("c12_prune")
def prune(spark, folder):
    """The tree without small leaves: nodes with their own members, a row a node."""
    nodes, members = _tree(spark, folder)
    counted = nodes.join(members.groupBy("node").agg(F.count("*").alias("n")), "node", "left").orderBy("node").collect()
    least = sorted(r["n"] for r in counted if r["n"])[5]
    kept = clusters.prune([(r["node"], r["parent"], r["n"] or 0) for r in counted], small=5, leaf=least)
    return spark.createDataFrame(kept, "node string, parent string, n long")


@register("c13_peak_k")
def peak_k(spark, folder):
    """The best k by steps of two from 2, until one is no better."""
    v = read_vectors(spark, folder).cache()
    k, found = clusters.peak_k(lambda k: clusters.silhouette_of(v, "v", k), 2, 2, 8, 1)
    v.unpersist()
    return spark.createDataFrame([(k, round(found, 6))], "k int, silhouette double")


@register("c14_agglomerative")
def agglomerative(spark, folder):
    c = routing.centroids(read_vectors(spark, folder), "label", "v").orderBy("label").collect()
    x = np.array([r["c"] for r in c])
    found = {kind: clusters.agglomerate(x, kind, k=4) for kind in ("single", "complete", "average", "ward")}
    return spark.createDataFrame([(r["label"], kind, labels[i]) for kind, labels in found.items() for i, r in enumerate(c)], "label int, linkage string, cluster int")


def _stable(frame):
    x = trees.matrix(frame["v"])
    groups = clusters.stabilise(x, frame["label"].to_numpy(), x.mean(axis=0), 0.2, 0.05, 0.9)
    return list(zip(frame["vec_id"].tolist(), groups.tolist(), strict=True))


@register("c15_stabilise")
def stabilise(spark, folder):
    return trees.in_parts(read_vectors(spark, folder), "vec_id", ["label", "v"], _stable, "vec_id long, cluster int")


@register("c16_dbscan", "WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, c_nationkey % 7 + 100 AS b FROM customer), n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT x AS node, x AS root FROM n UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.node) SELECT CAST(node AS BIGINT) AS node, CAST(min(root) AS BIGINT) AS root FROM r GROUP BY node")
def dbscan(spark, folder):
    """With one sample a core: components of the graph of near pairs."""
    e = table(spark, folder, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_nationkey") % 7 + 100).cast("long").alias("b")).distinct()
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    return graph.components(nodes, e)


@register("c16b_dbscan_distance", f"WITH RECURSIVE {CENTROIDS_SQL}, p AS (SELECT a.label AS a, b.label AS b FROM c a CROSS JOIN c b WHERE 1 - list_cosine_similarity(a.c, b.c) <= 0.95), k AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 4), r AS (SELECT a AS node, a AS root FROM k UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE p.b IN (SELECT a FROM k)), m AS (SELECT node, min(root) AS root FROM r GROUP BY node), n AS (SELECT p.a AS node, min(m.root) AS root FROM p JOIN m ON m.node = p.b GROUP BY p.a) SELECT c.label AS node, coalesce(m.root, n.root, c.label) AS root FROM c LEFT JOIN m ON m.node = c.label LEFT JOIN n ON n.node = c.label")
def dbscan_distance(spark, folder):
    """The labels' centroids within 0.95 of each other, four of them a core."""
    return clusters.dbscan(routing.centroids(read_vectors(spark, folder), "label", "v"), "label", "c", 0.95, 4)


@register("c17_medoids", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.label, a.vec_id, avg(1 - list_cosine_similarity(a.v, b.v)) AS d FROM e a JOIN e b USING (label) GROUP BY ALL) SELECT label, arg_min(vec_id, (round(d, 9), vec_id)) AS medoid FROM d GROUP BY label")
def medoids(spark, folder):
    """The member with the least mean cosine distance to its cluster: by linearity one dot product with the unit vectors' sum."""
    v = read_vectors(spark, folder).select("vec_id", "label", vectors.normalized(F.col("v")).alias("u"))
    mean = routing.centroids(v, "label", "u")
    d = v.join(F.broadcast(mean), "label").select("label", "vec_id", F.round(1 - vectors.dot(F.col("u"), F.col("c")), 9).alias("d"))
    return d.groupBy("label").agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("medoid"))


@register("c18_merged_vocabulary", "SELECT DISTINCT CASE WHEN lang IN ('fr', 'es') THEN 'romance' ELSE lang END AS tag FROM documents")
def merged_vocabulary(spark, folder):
    d = table(spark, folder, "documents").select(F.col("lang").alias("tag")).distinct()
    merge = spark.createDataFrame([("fr", "romance"), ("es", "romance")], "tag string, name string")
    return d.join(F.broadcast(merge), "tag", "left").select(F.coalesce("name", "tag").alias("tag")).distinct()


@register("c19_label_graph", f"WITH {CENTROIDS_SQL}, s AS (SELECT a.label AS src, b.label AS dst, list_cosine_similarity(a.c, b.c) AS s FROM c a CROSS JOIN c b), w AS (SELECT src, dst, CASE WHEN src = dst THEN s ELSE 0.5 * s END AS w FROM s WHERE s >= 0.05) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 6) AS w FROM w")
def label_graph(spark, folder):
    c = routing.centroids(read_vectors(spark, folder), "label", "v")
    return clusters.label_graph(c, "label", "c", 0.05, 0.5).select("src", "dst", F.round("w", 6).alias("w"))


@register("c20_flatten", f"WITH RECURSIVE {_TREE}, {_WALK} SELECT node, parent, CAST(depth AS INT) AS depth, array_to_string(path, '/') AS path FROM w")
def flatten(spark, folder):
    return graph.walk(_tree(spark, folder)[0]).select("node", "parent", "depth", F.array_join("path", "/").alias("path"))


@register("c21_subtree_ids", f"WITH RECURSIVE {_TREE}, {_WALK} SELECT a AS ancestor, count(DISTINCT id) AS n, min(id) AS least FROM w, unnest(path) x(a) JOIN m ON m.node = w.node GROUP BY a".replace("FROM w, unnest(path) x(a) JOIN m ON m.node = w.node", "FROM (SELECT node, unnest(path) AS a FROM w) w JOIN m ON m.node = w.node"))
def subtree_ids(spark, folder):
    nodes, members = _tree(spark, folder)
    below = graph.closure(graph.walk(nodes)).select("ancestor", "node")
    return below.join(members, "node").groupBy("ancestor").agg(F.count_distinct("id").alias("n"), F.min("id").alias("least"))


@register("c22_compact_names", "SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD BRUSHED ') THEN substr(p_type, 18) ELSE p_type END AS name FROM part")
def compact_names(spark, folder):
    """What a child's name shares with its parent's, two words or more, goes."""
    return table(spark, folder, "part").select("p_partkey", texts.compact_name(F.col("p_type"), F.lit("STANDARD BRUSHED")).alias("name"))


@register("c23_tree_fields", f"WITH RECURSIVE {_TREE}, {_WALK}, c AS (SELECT node, unnest(path) AS a FROM w), k AS (SELECT parent AS node, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY parent) SELECT c.a AS node, coalesce(any_value(k.children), 0) AS children_count, count(m.id) AS subtree_size, count(m.id) FILTER (c.node = c.a) AS own FROM c LEFT JOIN m ON m.node = c.node LEFT JOIN k ON k.node = c.a GROUP BY c.a")
def tree_fields(spark, folder):
    nodes, members = _tree(spark, folder)
    counts = members.groupBy("node").agg(F.count("*").alias("m"))
    below = graph.closure(graph.walk(nodes)).join(counts, "node", "left")
    sizes = below.groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("subtree_size"), F.coalesce(F.sum(F.when(F.col("distance") == 0, F.col("m"))), F.lit(0)).alias("own"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children_count"))
    return sizes.join(children, "node", "left").select("node", F.coalesce("children_count", F.lit(0)).alias("children_count"), "subtree_size", "own")


def _merged(frame):
    """The objective of a part's labels with each sample, taken out, on its own and in its nearest label."""
    x, labels = trees.matrix(frame["v"]), frame["label"].to_numpy()
    groups, out = {g: np.flatnonzero(labels == g) for g in np.unique(labels)}, []
    for i, key in enumerate(frame["vec_id"].tolist()):
        rest = [x[at[at != i]] for at in groups.values() if len(at[at != i])]
        if not rest:
            continue
        near = int(np.argmin([np.linalg.norm(g.mean(axis=0) - x[i]) for g in rest]))
        merged = [np.vstack([g, x[i][None]]) if k == near else g for k, g in enumerate(rest)]
        out.append((key, round(trees.objective([*rest, x[i][None]]), 5), round(trees.objective(merged), 5)))
    return out


@register("c24_virtual_merge")
def virtual_merge(spark, folder):
    return trees.in_parts(read_vectors(spark, folder), "vec_id", ["label", "v"], _merged, "vec_id long, apart double, merged double")


@register("c25_capped_reach", f"WITH RECURSIVE {_TREE}, w AS (SELECT node, length(node) * 1.0 AS reach FROM t WHERE parent IS NULL UNION ALL SELECT t.node, least(w.reach, length(t.node)) FROM t JOIN w ON t.parent = w.node) SELECT node, CAST(reach AS DOUBLE) AS reach FROM w")
def capped_reach(spark, folder):
    """A node's reach is at most its parent's: the least along the path."""
    walked = graph.walk(_tree(spark, folder)[0])
    return walked.select("node", F.array_min(F.transform("path", lambda p: F.length(p).cast("double"))).alias("reach"))


@register("c26_positional_names", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'child_' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR) END AS name FROM nation")
def positional_names(spark, folder):
    """Names of a model's reply; where there is none, by position among the siblings."""
    at = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    reply = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name"))
    return table(spark, folder, "nation").select("n_nationkey", F.coalesce(reply, F.concat(F.lit("child_"), at.cast("string"))).alias("name"))


@register("a21_tree_stats", f"WITH RECURSIVE {_TREE}, {_WALK} SELECT CAST(depth AS INT) AS depth, count(*) AS nodes FROM w GROUP BY depth")
def tree_stats(spark, folder):
    return graph.walk(_tree(spark, folder)[0]).groupBy("depth").agg(F.count("*").alias("nodes"))


@register("k10_rendered_tree", f"WITH RECURSIVE {_TREE}, {_WALK}, c AS (SELECT node, unnest(path) AS a FROM w), n AS (SELECT c.a AS node, count(m.id) AS n FROM c LEFT JOIN m ON m.node = c.node GROUP BY c.a) SELECT array_to_string(w.path, '/') AS path, repeat('  ', CAST(depth AS INT)) || w.node || ' (' || CAST(n.n AS VARCHAR) || ')' AS line FROM w JOIN n USING (node)")
def rendered_tree(spark, folder):
    nodes, members = _tree(spark, folder)
    walked = graph.walk(nodes)
    counts = graph.closure(walked).join(members.groupBy("node").agg(F.count("*").alias("m")), "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return walked.join(counts, "node").select(F.array_join("path", "/").alias("path"), line.alias("line"))


@register("f7_eligible_centroids", f"WITH RECURSIVE {_TREE}, {_WALK} SELECT w.node FROM w JOIN (SELECT node, count(*) AS n FROM m GROUP BY node) c USING (node) WHERE w.depth > 0 AND w.node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AND c.n >= 55")
def eligible_centroids(spark, folder):
    """Leaves that are not the root and hold enough members."""
    nodes, members = _tree(spark, folder)
    leaves = graph.walk(nodes).where("depth > 0").join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    return leaves.join(members.groupBy("node").agg(F.count("*").alias("n")).where("n >= 55"), "node").select("node")


@register("c27_tree_state")
def tree_state(spark, folder):
    """The nodes that grown trees hold at the end, with their members."""
    return _grown(spark, folder, lambda: trees.GrowingTree(1.1, scale=5.0), lambda tree: [(node, int(i), at) for node, at, i in tree.members()], "node string, vec_id long, at int")


@register("o28b_parent_options", f"WITH RECURSIVE {_TREE}, {_WALK}, n AS (SELECT c.a AS node, count(m.id) AS n FROM (SELECT node, unnest(path) AS a FROM w) c LEFT JOIN m ON m.node = c.node GROUP BY c.a), o AS (SELECT r_regionkey AS asked, node, depth, n FROM region, w JOIN n USING (node) WHERE depth < 2 OR parent = 'r' || CAST(r_regionkey AS VARCHAR)) SELECT asked, node, CAST(row_number() OVER (PARTITION BY asked ORDER BY depth, n DESC, node) AS INT) AS rank FROM o QUALIFY rank <= 8")
def parent_options(spark, folder):
    """Where a new node may go if a region's nations are the candidates: they, what is above them, and the top level."""
    nodes, members = _tree(spark, folder)
    walked = graph.walk(nodes)
    counts = graph.closure(walked).join(members.groupBy("node").agg(F.count("*").alias("m")), "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    candidates = table(spark, folder, "nation").select(F.col("n_regionkey").alias("asked"), F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.parent_options(walked, counts, candidates, "asked", most=8)
