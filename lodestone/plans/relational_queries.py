"""Queries of joins (J) and aggregates (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import routing
from lodestone.plans.registry import register
from lodestone.sources.tables import CENTROIDS_SQL, SAMPLES_SQL, VECTORS_SQL, samples, table
from lodestone.sources.tables import vectors as read_vectors

_ROUTE = CENTROIDS_SQL + ", sim AS (SELECT vec_id, c.label AS capability, list_cosine_similarity(v, c.c) AS s FROM e CROSS JOIN c), top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, capability) - 1 AS rank FROM sim QUALIFY rank < 3), routed AS (SELECT vec_id, CAST(rank AS INT) AS rank, capability, s, exp(s / 0.1) / sum(exp(s / 0.1)) OVER (PARTITION BY vec_id) AS w FROM top)"


def routed(spark, folder):
    v = read_vectors(spark, folder)
    return routing.route(v, "vec_id", "v", routing.centroids(v, "label", "v"), "label")


@register("route_topk", f"WITH {_ROUTE} SELECT vec_id, rank, capability, round(w, 6) AS weight FROM routed")
def route_topk(spark, folder):
    return routed(spark, folder).select("vec_id", "rank", "capability", F.round("weight", 6).alias("weight"))


def _two_key(spark, folder, how):
    """Data rows probe routing by id, then by row position."""
    data = table(spark, folder, "documents").select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("id"))
    route = table(spark, folder, "embeddings").select("vec_id", "label")
    by_id = data.join(route.withColumnsRenamed({"vec_id": "id", "label": "a"}), "id", "left")
    both = by_id.join(route.withColumnsRenamed({"vec_id": "position", "label": "b"}), "position", "left")
    found = both.select("position", F.coalesce("a", "b").alias("label"))
    return found.where("label is not null") if how == "inner" else found


_J1 = "SELECT d.doc_id AS position, coalesce(a.label, b.label) AS label FROM documents d LEFT JOIN embeddings a ON d.doc_id % 2 = 0 AND a.vec_id = d.doc_id LEFT JOIN embeddings b ON b.vec_id = d.doc_id"


@register("j1_routing_required", _J1 + " WHERE coalesce(a.label, b.label) IS NOT NULL")
def routing_required(spark, folder):
    return _two_key(spark, folder, "inner")


@register("j2_routing_optional", _J1)
def routing_optional(spark, folder):
    return _two_key(spark, folder, "left")


@register("j3_tags_and_delta", "SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), 0) AS delta, CASE WHEN b.item_id IS NULL THEN 0 ELSE 1 END AS tags FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def tags_and_delta(spark, folder):
    d = table(spark, folder, "documents").select("doc_id")
    j = d.join(table(spark, folder, "labels"), "doc_id", "left").join(table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.array("text").alias("t")), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("delta"), F.size(F.coalesce("t", F.array().cast("array<string>"))).alias("tags"))


@register("j4_tags", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def tags(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", "toxic")


@register("j5_selected_rows", "SELECT l.doc_id, coalesce(d.lang, 'score row') AS lang, CAST(l.quality AS DOUBLE) AS selection_scalar FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 5 <> 0 WHERE l.quality = 1")
def selected_rows(spark, folder):
    """Selected scores with their original rows, else the score row itself."""
    rows = table(spark, folder, "documents").where("doc_id % 5 <> 0").select("doc_id", "lang")
    return table(spark, folder, "labels").where("quality = 1").join(rows, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("score row")).alias("lang"), F.col("quality").cast("double").alias("selection_scalar"))


@register("j6_descriptors", "WITH x AS (SELECT vec_id, r, CASE WHEN r = 0 THEN label ELSE label * 4 END AS node FROM embeddings, range(2) t(r)) SELECT vec_id, CAST(r AS INT) AS rank, coalesce(a.n_name, 'index ' || CAST(b.n_nationkey AS VARCHAR)) AS name FROM x LEFT JOIN nation a ON a.n_nationkey = x.node AND a.n_nationkey < 15 LEFT JOIN nation b ON b.n_nationkey = x.node WHERE a.n_nationkey IS NOT NULL OR b.n_nationkey IS NOT NULL")
def descriptors(spark, folder):
    """Routed nodes with their descriptor by node, else by index; what is out of range goes."""
    x = table(spark, folder, "embeddings").select("vec_id", F.posexplode(F.array(F.col("label"), F.col("label") * 4)).alias("rank", "node"))
    nation = table(spark, folder, "nation")
    by_node = nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("node"), "n_name")
    by_index = nation.select(F.col("n_nationkey").alias("node"), F.concat(F.lit("index "), F.col("n_nationkey").cast("string")).alias("other"))
    j = x.join(by_node, "node", "left").join(by_index, "node", "left")
    return j.select("vec_id", "rank", F.coalesce("n_name", "other").alias("name")).where("name is not null")


@register("j7_decontamination", f"WITH {SAMPLES_SQL}, t AS (SELECT * FROM s WHERE doc_id % 2 = 0), v AS (SELECT * FROM s WHERE doc_id % 2 = 1 OR doc_id % 10 = 0) SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT doc_id FROM v) AND md5(instruction || '||' || input || '||' || output) NOT IN (SELECT md5(instruction || '||' || input || '||' || output) FROM v)")
def decontamination(spark, folder):
    """Training rows that share neither id nor content with the evaluation set: two anti joins, never one with OR."""
    s = samples(spark, folder).select("doc_id", F.md5(F.concat_ws("||", "instruction", "input", "output").cast("binary")).alias("content"))
    train, held = s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1 or doc_id % 10 = 0")
    return train.join(held.select("doc_id"), "doc_id", "left_anti").join(held.select("content"), "content", "left_anti").select("doc_id")


@register("j8_similarities", f"WITH {CENTROIDS_SQL} SELECT vec_id, c.label AS capability, round(list_cosine_similarity(v, c.c), 6) AS similarity FROM e CROSS JOIN c")
def similarities(spark, folder):
    v = read_vectors(spark, folder)
    c = routing.centroids(v, "label", "v")
    return routing.route(v, "vec_id", "v", c, "label", k=routing.MOST_CENTROIDS).select("vec_id", "capability", F.round("similarity", 6).alias("similarity"))


@register("j9_tag_cosines", f"WITH {CENTROIDS_SQL} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM c a JOIN c b ON a.label < b.label")
def tag_cosines(spark, folder):
    """All pairs of a bounded vocabulary (ten labels)."""
    c = routing.centroids(read_vectors(spark, folder), "label", "v").select("label", "c")
    right = c.withColumnsRenamed({"label": "b", "c": "d"})
    return c.join(F.broadcast(right), F.col("label") < F.col("b")).select(F.col("label").alias("a"), "b", F.round(vectors.cosine(F.col("c"), F.col("d")), 6).alias("similarity"))


@register("j10_tag_clusters", "SELECT o_custkey, list(DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT)) AS clusters FROM orders GROUP BY o_custkey")
def tag_clusters(spark, folder):
    tagged = table(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    clusters = tagged.select("o_orderpriority").distinct().withColumn("cluster", F.substring("o_orderpriority", 1, 1).cast("int"))
    return tagged.distinct().join(clusters, "o_orderpriority").groupBy("o_custkey").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))


@register("j11_members_profiles", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def members_profiles(spark, folder):
    j = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels").withColumn("hit", F.lit(1)), "doc_id", "left")
    return j.agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("missing"))


@register("j12_category_lookup", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS category FROM documents d LEFT JOIN labels l USING (doc_id)")
def category_lookup(spark, folder):
    j = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("c")), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.nullif(F.trim("c"), F.lit("")), "source").alias("category"))


@register("j13_method_scores", "SELECT d.doc_id, m.method, CAST(coalesce(CASE m.method WHEN 'quality' THEN l.quality ELSE l.toxic END, 0) AS DOUBLE) AS score FROM documents d CROSS JOIN (VALUES ('quality'), ('toxic')) m(method) LEFT JOIN labels l USING (doc_id)")
def method_scores(spark, folder):
    """Score files of several methods as one long table, absent ones 0."""
    j = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    methods = F.array(F.struct(F.lit("quality").alias("method"), F.col("quality").alias("s")), F.struct(F.lit("toxic").alias("method"), F.col("toxic").alias("s")))
    return j.select("doc_id", F.explode(methods).alias("m")).select("doc_id", "m.method", F.coalesce(F.col("m.s"), F.lit(0)).cast("double").alias("score"))


@register("j14_nearest", f"WITH {_ROUTE} SELECT vec_id, capability FROM routed WHERE rank = 0")
def nearest(spark, folder):
    return routed(spark, folder).where("rank = 0").select("vec_id", "capability")


@register("j15_append", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def append(spark, folder):
    """Rows not seen before, up to the cap, in order."""
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(100)


@register("j16_logs_by_method", "SELECT 'orders' AS method, o_orderkey AS step FROM orders UNION ALL SELECT 'events', event_id FROM events")
def logs_by_method(spark, folder):
    a = table(spark, folder, "orders").select(F.lit("orders").alias("method"), F.col("o_orderkey").alias("step"))
    return a.unionByName(table(spark, folder, "events").select(F.lit("events").alias("method"), F.col("event_id").alias("step")))


@register("a1_group_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@register("a2_skip_reasons", "WITH t AS (SELECT conv_id, bool_or(role = 'user' AND trim(text) <> '') AS u, bool_or(role = 'system') AS y FROM conversations GROUP BY conv_id) SELECT u, y, count(*) AS n FROM t GROUP BY u, y")
def skip_reasons(spark, folder):
    t = table(spark, folder, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("role") == "user") & (F.trim("text") != "")).alias("u"), F.bool_or(F.col("role") == "system").alias("y"))
    return t.groupBy("u", "y").agg(F.count("*").alias("n"))


@register("a3_signatures", "WITH g AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source, lang), r AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS labels, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM g) SELECT source, CAST(max(total) AS BIGINT) AS total, max(labels) AS labels, max(CASE WHEN k = 1 THEN lang END) AS dominant, round(max(CASE WHEN k = 1 THEN n END) / max(total), 6) AS ratio, list(lang ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY source")
def signatures(spark, folder):
    """Label distribution of each cluster; ties by first occurrence."""
    g = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("f"), F.col("lang"))))
    s = g.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("labels"), ranked.alias("r"))
    return s.select("source", "total", "labels", F.get("r.lang", F.lit(0)).alias("dominant"), F.round(-F.get("r.k", F.lit(0)) / F.col("total"), 6).alias("ratio"), F.slice("r.lang", 1, 5).alias("top"))


@register("a4_centroids", f"WITH {CENTROIDS_SQL} SELECT label, i, round(c[i], 6) AS x FROM c, range(1, 65) t(i)")
def centroids(spark, folder):
    c = routing.centroids(read_vectors(spark, folder), "label", "v")
    return c.select("label", F.posexplode("c").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@register("a5_weighted_centroids", f"WITH {CENTROIDS_SQL}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), p AS (SELECT label % 3 AS parent, i, sum(n * c[i]) / sum(n) AS x FROM c JOIN n USING (label), range(1, 65) t(i) GROUP BY 1, 2) SELECT CAST(parent AS INT) AS parent, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY parent)), 6) AS x FROM p")
def weighted_centroids(spark, folder):
    """Parents' centres: their children's, weighted by members, at unit length."""
    c = routing.centroids(read_vectors(spark, folder), "label", "v")
    flat = c.select((F.col("label") % 3).cast("int").alias("parent"), "n", F.posexplode("c").alias("i", "x"))
    mean = flat.groupBy("parent", "i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("parent")))
    return mean.select("parent", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("x") / length, 6).alias("x"))


_DIST = CENTROIDS_SQL + ", d AS (SELECT label, vec_id, list_distance(v, c) AS d FROM e JOIN c USING (label))"


def _distances(spark, folder):
    v = read_vectors(spark, folder)
    return routing.distance_to(v, "label", "v", routing.centroids(v, "label", "v"))


@register("a6_risk", f"WITH {_DIST} SELECT label, round(sum(d * d), 6) AS sse, round(sum(d * d) / count(*), 6) AS radius, round(sum(d * d) / count(*) / count(*), 6) AS density FROM d GROUP BY label")
def risk(spark, folder):
    g = _distances(spark, folder).groupBy("label").agg(F.sum(F.col("d") * F.col("d")).alias("s"), routing.risk(F.col("d")).alias("r"))
    return g.select("label", F.round("s", 6).alias("sse"), F.round("r.radius", 6).alias("radius"), F.round("r.density", 6).alias("density"))


@register("a7_density", f"WITH {_DIST} SELECT label, round(count(*) * (2 - avg(d)), 5) AS density FROM d GROUP BY label")
def density(spark, folder):
    one = F.when(F.count("*") == 1, 2.0).otherwise(F.count("*") * (2 - F.avg("d")))
    return _distances(spark, folder).groupBy("label").agg(F.round(one, 5).alias("density"))


_SEP = "sep AS (SELECT a.label, avg(list_distance(a.c, b.c)) AS sep FROM c a JOIN c b ON a.label <> b.label GROUP BY a.label)"


def _separation(spark, folder):
    """Mean distance to the other centres; the centres are one broadcast row, as in routing."""
    c = routing.centroids(read_vectors(spark, folder), "label", "v").select("label", "c")
    every = c.agg(F.collect_list(F.struct("label", "c")).alias("o"))
    others = F.filter("o", lambda o: o["label"] != F.col("label"))
    mean = F.aggregate(others, F.lit(0.0), lambda a, o: a + vectors.euclidean(F.col("c"), o["c"])) / F.size(others)
    return c.join(F.broadcast(every)).select("label", F.coalesce(mean, F.lit(0.0)).alias("sep"))


@register("a8_separation", f"WITH {CENTROIDS_SQL}, {_SEP} SELECT label, round(sep, 6) AS sep FROM sep")
def separation(spark, folder):
    return _separation(spark, folder).select("label", F.round("sep", 6).alias("sep"))


@register("a9_objective", f"WITH {_DIST}, {_SEP}, den AS (SELECT label, count(*) * (2 - avg(d)) AS den FROM d GROUP BY label) SELECT round(sum(den * sep), 3) AS j FROM den JOIN sep USING (label)")
def objective(spark, folder):
    den = _distances(spark, folder).groupBy("label").agg(F.when(F.count("*") == 1, 2.0).otherwise(F.count("*") * (2 - F.avg("d"))).alias("den"))
    return den.join(_separation(spark, folder), "label").agg(F.round(F.sum(F.col("den") * F.col("sep")), 3).alias("j"))


@register("a10_alignment", f"WITH {_DIST}, t AS (SELECT c AS t FROM c WHERE label = 0), r AS (SELECT label, avg(d) AS r FROM d GROUP BY label) SELECT c.label, round(greatest(0, least(1, list_cosine_similarity(c.c, t.t))), 6) AS a, round(greatest(0, least(1, list_cosine_similarity(c.c, t.t))) / (r + 1e-5), 5) AS rho FROM c, t JOIN r ON r.label = c.label" .replace("FROM c, t JOIN r ON r.label = c.label", "FROM c CROSS JOIN t JOIN r ON r.label = c.label"))
def alignment(spark, folder):
    c = routing.centroids(read_vectors(spark, folder), "label", "v").select("label", "c")
    target = c.where("label = 0").select(F.col("c").alias("t"))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), vectors.cosine(F.col("c"), F.col("t"))))
    r = _distances(spark, folder).groupBy("label").agg(F.avg("d").alias("r"))
    return c.join(F.broadcast(target)).join(r, "label").select("label", F.round(a, 6).alias("a"), F.round(a / (F.col("r") + 1e-5), 5).alias("rho"))


@register("a11_turn_aggregation", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS total, round(avg(length(text)), 6) AS mean, CAST(max(length(text)) AS INT) AS most FROM conversations GROUP BY conv_id")
def turn_aggregation(spark, folder):
    n = F.length("text")
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"))


@register("a12_vector_scalars", f"WITH {VECTORS_SQL} SELECT vec_id, round(list_sum(v), 6) AS total, round(list_max(v), 6) AS most, round(list_sum(list_filter(v, lambda x: abs(x) > 1e-12)) / greatest(1, len(list_filter(v, lambda x: abs(x) > 1e-12))), 6) AS mean_nonzero, round(list_sum(v) / 3, 6) AS mean_topk FROM e")
def vector_scalars(spark, folder):
    some = F.filter("v", lambda x: F.abs(x) > 1e-12)
    return read_vectors(spark, folder).select("vec_id", F.round(vectors.total(F.col("v")), 6).alias("total"), F.round(F.array_max("v"), 6).alias("most"), F.round(vectors.total(some) / F.greatest(F.lit(1), F.size(some)), 6).alias("mean_nonzero"), F.round(vectors.total(F.col("v")) / 3, 6).alias("mean_topk"))


@register("a13_dimension_stats", f"WITH {VECTORS_SQL} SELECT i, round(avg(v[i]), 6) AS mean, round(greatest(stddev_pop(v[i]), 1e-6), 6) AS std FROM e, range(1, 65) t(i) GROUP BY i")
def dimension_stats(spark, folder):
    flat = read_vectors(spark, folder).select(F.posexplode("v").alias("i", "x"))
    return flat.groupBy((F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("x"), F.lit(1e-6)), 6).alias("std"))


@register("a14_dimension_totals", "SELECT CAST(i AS INT) AS cap, round(sum(CAST(embedding[i + 1] AS DOUBLE)), 5) AS total FROM embeddings, range(64) t(i) WHERE embedding[i + 1] > 0 GROUP BY i")
def dimension_totals(spark, folder):
    flat = table(spark, folder, "embeddings").select(F.posexplode("embedding").alias("cap", "x")).where("x > 0")
    return flat.groupBy("cap").agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("total"))


@register("a15_minmax_l1", f"WITH {VECTORS_SQL}, x AS (SELECT vec_id, i, greatest(v[i], 0) AS x FROM e, range(1, 9) t(i)), m AS (SELECT min(x) AS lo, max(x) AS hi FROM x), s AS (SELECT vec_id, i, (x - lo) / (hi - lo) AS s FROM x CROSS JOIN m) SELECT vec_id, i, round(CASE WHEN sum(s) OVER (PARTITION BY vec_id) > 0 THEN s / sum(s) OVER (PARTITION BY vec_id) ELSE 0 END, 6) AS s FROM s")
def minmax_l1(spark, folder):
    """Scaled by the least and largest entry of the whole matrix, zeros included, then to sum 1 a row."""
    x = read_vectors(spark, folder).select("vec_id", F.transform(F.slice("v", 1, 8), lambda y: F.greatest(y, F.lit(0.0))).alias("x"))
    m = x.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))
    scaled = x.join(F.broadcast(m)).select("vec_id", F.transform("x", lambda y: F.when(F.col("hi") > F.col("lo"), (y - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).alias("s"))
    summed = scaled.select("vec_id", "s", vectors.total(F.col("s")).alias("t"))
    return summed.select("vec_id", F.posexplode("s").alias("i", "y"), "t").select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round(F.when(F.col("t") > 0, F.col("y") / F.col("t")).otherwise(0.0), 6).alias("s"))


@register("a16_cluster_distribution", "SELECT c, count(*) AS n FROM (SELECT unnest([o_orderstatus, substr(o_orderpriority, 1, 1)]) AS c FROM orders) GROUP BY c")
def cluster_distribution(spark, folder):
    return table(spark, folder, "orders").select(F.explode(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@register("a17_attention_mean", "WITH s AS (SELECT l_partkey, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS s FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_partkey) SELECT p_partkey, round(coalesce(s.s, (SELECT avg(s) FROM s)), 3) AS score FROM part LEFT JOIN s ON s.l_partkey = p_partkey")
def attention_mean(spark, folder):
    """Weighted mean a demo; demos never seen get the mean of the seen."""
    seen = table(spark, folder, "lineitem").where("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity")).alias("s"))
    mean = seen.agg(F.avg("s").alias("m"))
    return table(spark, folder, "part").select("p_partkey").join(seen, "p_partkey", "left").join(F.broadcast(mean)).select("p_partkey", F.round(F.coalesce("s", "m"), 3).alias("score"))


@register("a18_metric_means", "SELECT round(avg(value), 5) AS value, round(avg(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)), 5) AS k FROM events WHERE value IS NOT NULL AND TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) IS NOT NULL")
def metric_means(spark, folder):
    e = table(spark, folder, "events").select("value", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("k")).dropna()
    return e.agg(F.round(F.avg("value"), 5).alias("value"), F.round(F.avg("k"), 5).alias("k"))


@register("a19_run_scores", "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(100 * avg(value), 3) AS percent, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def run_scores(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(100 * F.avg("value"), 3).alias("percent"), F.round(F.sum("value"), 3).alias("total"))


@register("a19b_language_counts", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other FROM documents GROUP BY source")
def language_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"))


@register("a20_perplexity", "SELECT event_type, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS nll, round(exp(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1) / 100), 5) AS ppl FROM events GROUP BY event_type")
def perplexity(spark, folder):
    n = F.col("user_id") % 7 + 1
    nll = F.sum(F.col("value") * n) / F.sum(n)
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(nll, 6).alias("nll"), F.round(F.exp(nll / 100), 5).alias("ppl"))


@register("a22_group_sizes", "SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def group_sizes(spark, folder):
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@register("a23_idf", "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations), n AS (SELECT count(*) AS n FROM conversations) SELECT w AS word, round(ln((n + 1) / (count(*) + 1)) + 1, 6) AS idf FROM w CROSS JOIN n GROUP BY w, n")
def idf(spark, folder):
    c = table(spark, folder, "conversations")
    n = c.count()
    return c.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word")).groupBy("word").agg(F.round(F.log((n + 1) / (F.count("*") + 1)) + 1, 6).alias("idf"))


@register("a24_relation_counts", "SELECT count(*) FILTER (quality = 1) AS strong, count(*) FILTER (quality = 0 AND toxic = 0) AS weak, count(*) FILTER (toxic = 1 AND quality = 0) AS unrelated FROM labels")
def relation_counts(spark, folder):
    return table(spark, folder, "labels").agg(F.count_if(F.col("quality") == 1).alias("strong"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("weak"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("unrelated"))


@register("a25_missing_keys", "SELECT count(*) FILTER (l.doc_id IS NULL) AS no_label, count(*) FILTER (b.item_id IS NULL) AS no_item FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def missing_keys(spark, folder):
    j = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left").join(table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("b")), "doc_id", "left")
    return j.agg(F.count_if(F.col("toxic").isNull()).alias("no_label"), F.count_if(F.col("b").isNull()).alias("no_item"))


@register("a26_beta", f"WITH {CENTROIDS_SQL}, n AS (SELECT label, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c), b AS (SELECT label, n / sum(n) OVER () AS b FROM n), m AS (SELECT label, 0.9 * 0.1 + 0.1 * b AS m FROM b) SELECT label, round(m / sum(m) OVER (), 6) AS beta FROM m")
def beta(spark, folder):
    """Shares of gradient norms, averaged into equal weights of before, and normalised again. A row a capability."""
    c = routing.centroids(read_vectors(spark, folder), "label", "v").select("label", vectors.norm(F.col("c")).alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    m = c.join(F.broadcast(t)).select("label", (0.9 / F.col("k") + 0.1 * F.col("n") / F.col("t")).alias("m"))
    return m.join(F.broadcast(m.agg(F.sum("m").alias("s")))).select("label", F.round(F.col("m") / F.col("s"), 6).alias("beta"))


@register("a27_numeric_columns", "SELECT 'o_orderpriority' AS name, count(TRY_CAST(o_orderpriority AS DOUBLE)) = count(*) AS is_numeric FROM orders UNION ALL SELECT 'o_totalprice', count(TRY_CAST(o_totalprice AS DOUBLE)) = count(*) FROM orders")
def numeric_columns(spark, folder):
    o = table(spark, folder, "orders")
    names = ("o_orderpriority", "o_totalprice")
    found = o.agg(*[(F.count(F.col(c).cast("string").try_cast("double")) == F.count("*")).alias(c) for c in names])
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("is_numeric")) for c in names])).alias("x")).select("x.*")


@register("a28_vocabulary", "SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS tag FROM part")
def vocabulary(spark, folder):
    return table(spark, folder, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("tag")).distinct()


@register("a29_steps", "SELECT CAST(ceil(ceil(count(*) / 8.0) / 4.0) * 3 AS BIGINT) AS steps FROM documents")
def steps(spark, folder):
    return table(spark, folder, "documents").agg((F.ceil(F.ceil(F.count("*") / 8) / 4) * 3).cast("long").alias("steps"))


@register("a30_anchor_gradients", f"WITH {CENTROIDS_SQL} SELECT label, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS norm, round(c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS first FROM c")
def anchor_gradients(spark, folder):
    c = routing.centroids(read_vectors(spark, folder), "label", "v")
    return c.select("label", F.round(vectors.norm(F.col("c")), 6).alias("norm"), F.round(vectors.normalized(F.col("c"))[0], 6).alias("first"))
