"""Queries of sorts, limits, samples and greedy selection (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import ingest, routing, selection
from lodestone.plans.registry import register
from lodestone.plans.relational_queries import _DIST, _ROUTE, _distances, routed
from lodestone.sources.tables import VECTORS_SQL, table
from lodestone.sources.tables import vectors as read_vectors

_H = "md5(CAST(doc_id AS VARCHAR) || '|42')"


@register("o1_scalar_topk", "SELECT d.doc_id, CAST(row_number() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS INT) AS selection_rank FROM documents d LEFT JOIN labels l USING (doc_id) QUALIFY selection_rank <= 300")
def scalar_topk(spark, folder):
    j = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", "quality")
    return selection.scalar_topk(j, "quality", "doc_id", 300).select("doc_id", "selection_rank")


def _sparse(spark, folder):
    """Routed weights as sparse vectors (position, vector)."""
    r = routed(spark, folder).groupBy(F.col("vec_id").alias("position")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("capability", F.round("weight", 6).alias("w"))))).alias("vector"))
    return r


@register("o2_vector_greedy")
def vector_greedy(spark, folder):
    """Order and gains of a greedy selection; checked against plain greedy in the tests."""
    chosen = selection.vector_greedy(_sparse(spark, folder), 40)
    return spark.createDataFrame([(p, i + 1, round(g, 6)) for i, (p, g) in enumerate(chosen)], "vec_id long, selection_rank int, selection_gain double")


@register("o3_strategy", "SELECT CASE WHEN max(len(embedding)) > 0 THEN 'vector_greedy' ELSE 'scalar_topk' END AS strategy FROM embeddings")
def strategy(spark, folder):
    return table(spark, folder, "embeddings").agg(F.when(F.max(F.size("embedding")) > 0, "vector_greedy").otherwise("scalar_topk").alias("strategy"))


@register("o4_topk_softmax", f"WITH {_ROUTE} SELECT vec_id, list(capability ORDER BY rank) AS top_k_indices, round(sum(w), 6) AS total FROM routed GROUP BY vec_id")
def topk_softmax(spark, folder):
    r = routed(spark, folder).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "capability"))).alias("r"), F.round(F.sum("weight"), 6).alias("total"))
    return r.select("vec_id", F.transform("r", lambda x: x["capability"]).alias("top_k_indices"), "total")


@register("o5_diverse")
def diverse(spark, folder):
    tagged = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("position")).agg(F.collect_set("role").alias("roles"), F.max("turn").alias("t"))
    rows = tagged.select("position", F.array_union("roles", F.transform(F.sequence(F.lit(0), F.col("t")), lambda i: i.cast("string"))).alias("tags"))
    return selection.diverse(rows, 50)


@register("o6_mig_greedy")
def mig_greedy(spark, folder):
    chosen = selection.mig_greedy(_sparse(spark, folder), 40)
    return spark.createDataFrame([(p, i + 1, round(g, 6)) for i, (p, g) in enumerate(chosen)], "vec_id long, selection_rank int, selection_gain double")


@register("o6b_mig_exponential")
def mig_exponential(spark, folder):
    """The same with gains that fall exponentially."""
    chosen = selection.mig_greedy(_sparse(spark, folder), 40, phi="exp", alpha=0.5)
    return spark.createDataFrame([(p, i + 1, round(g, 6)) for i, (p, g) in enumerate(chosen)], "vec_id long, selection_rank int, selection_gain double")


@register("o7_score_order", "SELECT event_id, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS INT) AS selection_rank FROM events QUALIFY selection_rank <= 100")
def score_order(spark, folder):
    return selection.scalar_topk(table(spark, folder, "events").select("event_id", "value"), "value", "event_id", 100).select("event_id", "selection_rank")


_HAM = "n AS (SELECT {g} AS g, count(*) AS size FROM documents GROUP BY {g}), x AS (SELECT g, size, {b} * size / (sum(size) OVER ())::DOUBLE AS x FROM n), f AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY x - floor(x) DESC, g) AS r, {b} - sum(floor(x)) OVER () AS rest FROM x), q AS (SELECT g, size, CAST(fl + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"


@register("o8_hamilton_quotas", "WITH " + _HAM.format(g="source", b=137) + " SELECT g AS source, size, quota FROM q")
def hamilton(spark, folder):
    sizes = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return selection.quotas(sizes, "source", "size", 137)


@register("o9_level_quotas", "WITH n AS (SELECT lang AS level, count(*) AS size FROM documents GROUP BY lang), x AS (SELECT level, size, least(5, size) AS base FROM n), y AS (SELECT *, (80 - sum(base) OVER ()) * (size - base) / (sum(size - base) OVER ())::DOUBLE AS x, 80 - sum(base) OVER () AS b FROM x), f AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, level) AS r, b - sum(floor(x)) OVER () AS rest FROM y) SELECT level, CAST(base + floor(x) + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def level_quotas(spark, folder):
    """A floor for each level, the rest by what is left of the levels."""
    sizes = table(spark, folder, "documents").groupBy(F.col("lang").alias("level")).agg(F.count("*").alias("size")).withColumn("base", F.least(F.lit(5), "size"))
    spent = sizes.agg(F.sum("base")).first()[0]
    rest = selection.quotas(sizes.select("level", (F.col("size") - F.col("base")).alias("size")), "level", "size", 80 - spent)
    return sizes.select("level", "base").join(F.broadcast(rest.select("level", "quota")), "level").select("level", (F.col("base") + F.col("quota")).cast("long").alias("quota"))


@register("o10_near_far", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) / 0.75::DOUBLE AS p, 0 AS side FROM documents WHERE lang = 'en'), f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) / 0.25::DOUBLE AS p, 1 AS side FROM documents WHERE lang <> 'en') SELECT doc_id, row_number() OVER (ORDER BY p, side, doc_id) - 1 AS position FROM (SELECT * FROM n UNION ALL SELECT * FROM f)")
def near_far(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "lang")
    return selection.interleaved(d.where("lang = 'en'").select("doc_id"), d.where("lang <> 'en'").select("doc_id"), "doc_id", 0.75)


_PICK = f" , p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H}, doc_id) AS r FROM documents)"


@register("o11_group_sample", "WITH " + _HAM.format(g="source", b=137) + _PICK + " SELECT doc_id, source FROM p JOIN q ON q.g = p.source WHERE r <= quota")
def group_sample(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source")
    plan = selection.quotas(d.groupBy("source").agg(F.count("*").alias("size")), "source", "size", 137)
    return selection.sample_by_quota(d, "doc_id", "source", plan, 137)


_UNI = "n AS (SELECT {g} AS g, count(*) AS size, row_number() OVER (ORDER BY {g}) AS i, count(*) OVER () AS k FROM documents GROUP BY {g}), q AS (SELECT g, least(size, {b} // k + CASE WHEN i <= {b} % k THEN 1 ELSE 0 END) AS quota FROM n), p AS (SELECT doc_id, {g} AS g, row_number() OVER (PARTITION BY {g} ORDER BY " + _H + ", doc_id) AS r FROM documents), picked AS (SELECT doc_id, g FROM p JOIN q USING (g) WHERE r <= quota), more AS (SELECT doc_id, {g} AS g FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM picked) ORDER BY " + _H + ", doc_id LIMIT (SELECT {b} - count(*) FROM picked))"


def _uniform(spark, folder, group, budget):
    d = table(spark, folder, "documents").select("doc_id", group)
    plan = selection.uniform_quotas(d.groupBy(group).agg(F.count("*").alias("size")), group, "size", budget)
    return selection.sample_by_quota(d, "doc_id", group, plan, budget)


@register("o12_category_sample", "WITH " + _UNI.format(g="lang", b=500) + " SELECT doc_id, g AS lang FROM picked UNION ALL SELECT doc_id, g FROM more")
def category_sample(spark, folder):
    """Equal quotas by language, and what small ones lack from all others."""
    return _uniform(spark, folder, "lang", 500)


@register("o13_source_sample", "WITH " + _UNI.format(g="source", b=333) + " SELECT doc_id, g AS source FROM picked UNION ALL SELECT doc_id, g FROM more")
def source_sample(spark, folder):
    return _uniform(spark, folder, "source", 333)


@register("o14_kmeans_sample")
def kmeans_sample(spark, folder):
    """Equal quotas by k-means cluster."""
    from lodestone.operators import clusters

    v = read_vectors(spark, folder)
    found = clusters.kmeans(v, "v", 8, seed=42).select(F.col("vec_id").alias("doc_id"), "cluster")
    plan = selection.uniform_quotas(found.groupBy("cluster").agg(F.count("*").alias("size")), "cluster", "size", 100)
    return selection.sample_by_quota(found, "doc_id", "cluster", plan, 100).withColumnRenamed("doc_id", "vec_id")


@register("o15_simple_sample", f"SELECT doc_id FROM documents ORDER BY {_H}, doc_id LIMIT 100")
def simple_sample(spark, folder):
    return selection.simple_sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 100)


@register("o16_split", f"SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) <= greatest(1, floor(count(*) OVER () * 0.05)) AS is_test FROM documents")
def split(spark, folder):
    return selection.split(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.05)


@register("o17_keep_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def keep_first(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@register("o18_last_wins", "SELECT user_id, arg_max(value, event_id) AS last, arg_min(value, event_id) AS first FROM events GROUP BY user_id")
def last_wins(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last"), F.min_by("value", "event_id").alias("first"))


@register("o19_representatives", f"WITH {_DIST} SELECT label, vec_id FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) <= 3")
def representatives(spark, folder):
    return ingest.top_of_each(_distances(spark, folder).select("label", "vec_id", "d"), "label", 3, F.round("d", 9), F.col("vec_id")).select("label", "vec_id")


@register("o20_pools", f"WITH {_ROUTE} SELECT capability, vec_id FROM routed QUALIFY row_number() OVER (PARTITION BY capability ORDER BY round(w, 9) DESC, vec_id) <= 10")
def pools(spark, folder):
    return ingest.top_of_each(routed(spark, folder), "capability", 10, F.desc(F.round("weight", 9)), F.col("vec_id")).select("capability", "vec_id")


@register("o21_contexts", f"WITH p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS r FROM embeddings QUALIFY r <= 4) SELECT e.vec_id, p.vec_id AS context FROM embeddings e JOIN p USING (label) WHERE p.vec_id <> e.vec_id QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY p.r) <= 3")
def contexts(spark, folder):
    """Three of the capability's pool of four for each row, never itself: the pool is an array beside each row."""
    e = table(spark, folder, "embeddings").select("label", "vec_id")
    pool = ingest.top_of_each(e, "label", 4, ingest.hash_order("vec_id"), F.col("vec_id")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "vec_id"))), lambda s: s["vec_id"]).alias("pool"))
    return e.join(pool, "label").select("vec_id", F.explode(F.slice(F.filter("pool", lambda p: p != F.col("vec_id")), 1, 3)).alias("context"))


@register("o22_ratio_subset", "SELECT event_id FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM events)")
def ratio_subset(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value")
    return selection.scalar_topk(e, "value", "event_id", max(1, int(e.count() * 0.05))).select("event_id")


@register("o23_cluster_ratio", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.1))")
def cluster_ratio(spark, folder):
    e = table(spark, folder, "embeddings").select("label", "vec_id")
    plan = e.groupBy("label").agg(F.count("*").alias("size")).withColumn("quota", F.greatest(F.lit(1), F.floor(F.col("size") * 0.1)))
    return selection.sample_by_quota(e, "vec_id", "label", plan, 0)


@register("o24_dimension_topk", f"WITH {VECTORS_SQL} SELECT CAST(i - 1 AS INT) AS dim, vec_id FROM e, range(1, 5) t(i) QUALIFY row_number() OVER (PARTITION BY i ORDER BY v[i] DESC, vec_id) <= 5")
def dimension_topk(spark, folder):
    flat = read_vectors(spark, folder).select("vec_id", F.posexplode(F.slice("v", 1, 4)).alias("dim", "x"))
    return ingest.top_of_each(flat, "dim", 5, F.desc("x"), F.col("vec_id")).select("dim", "vec_id")


@register("o25_alpha_topk", f"WITH {VECTORS_SQL} SELECT vec_id FROM e ORDER BY round(0.4 * v[1] + 0.3 * v[2] + 0.2 * v[3] + 0.1 * v[4], 9) DESC, vec_id LIMIT 25")
def alpha_topk(spark, folder):
    s = F.round(0.4 * F.col("v")[0] + 0.3 * F.col("v")[1] + 0.2 * F.col("v")[2] + 0.1 * F.col("v")[3], 9)
    return selection.scalar_topk(read_vectors(spark, folder).select("vec_id", s.alias("s")), "s", "vec_id", 25).select("vec_id")


@register("o26_chunks", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER () / 7.0) AS BIGINT) AS INT) AS chunk FROM documents")
def chunks(spark, folder):
    return selection.chunks(table(spark, folder, "documents").select("doc_id"), 7, "doc_id")


@register("o27_eval_sample", f"SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id LIMIT 50")
def eval_sample(spark, folder):
    return selection.simple_sample(table(spark, folder, "documents").select("doc_id"), "doc_id", 50, seed=7)


@register("o28_route_candidates", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), pos AS (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) t(i) GROUP BY label, i), c AS (SELECT label, list(a ORDER BY i) AS c FROM pos GROUP BY label) SELECT vec_id, c.label AS leaf FROM e CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, c.c), 9), c.label) <= 5")
def route_candidates(spark, folder):
    """The five nearest leaves by distance; leaves are one broadcast row."""
    v = read_vectors(spark, folder)
    leaves = routing.centroids(v, "label", "v").agg(F.collect_list(F.struct("label", "c")).alias("leaves"))
    near = F.array_sort(F.transform("leaves", lambda t: F.struct(F.round(vectors.euclidean(F.col("v"), t["c"]), 9).alias("d"), t["label"].alias("label"))))
    return v.join(F.broadcast(leaves)).select("vec_id", F.explode(F.slice(near, 1, 5)).alias("x")).select("vec_id", F.col("x.label").alias("leaf"))


@register("o29_micro_batches", "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch, count(*) OVER (PARTITION BY 1) AS n, doc_id FROM documents")
def micro_batches(spark, folder):
    d = table(spark, folder, "documents").select("doc_id")
    n = d.count()
    return selection.positions(d, "doc_id").select(F.floor(F.col("position") / 64).alias("batch"), F.lit(n).cast("long").alias("n"), "doc_id")


@register("o30_first_of_each", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 12")
def first_of_each(spark, folder):
    return ingest.top_of_each(table(spark, folder, "documents").select("lang", "doc_id"), "lang", 12, F.col("doc_id")).select("lang", "doc_id")


@register("o31_shared_eval", f"WITH t AS (SELECT doc_id FROM documents ORDER BY {_H}, doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM documents)) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def shared_eval(spark, folder):
    """Rows that train once the shared evaluation rows are taken out."""
    d = table(spark, folder, "documents").select("doc_id")
    held = selection.simple_sample(d, "doc_id", max(1, int(d.count() * 0.1)))
    return d.join(held, "doc_id", "left_anti")
