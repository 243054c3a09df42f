"""Queries of scorers and adaptive weights (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import texts, vectors
from lodestone.operators import ingest, models, routing, scoring
from lodestone.plans.registry import register
from lodestone.plans.relational_queries import _ROUTE, routed
from lodestone.sources.tables import CENTROIDS_SQL, VECTORS_SQL, table
from lodestone.sources.tables import vectors as read_vectors

_REL = "CASE (vec_id + rank) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 ELSE 0.0 END"


def _related(spark, folder):
    """Routed rows with a relation that stands in for a model's: strong, weak and none in turn."""
    turn = (F.col("vec_id") + F.col("rank")) % 3
    relation = F.when(turn == 0, "strongly related").when(turn == 1, "weakly related").otherwise("unrelated")
    return routed(spark, folder).select(F.col("vec_id").alias("id"), F.col("capability").alias("cap"), F.col("weight").alias("score"), relation.alias("relation"), "rank")


@register("u1_late_fusion", f"WITH {_ROUTE} SELECT vec_id AS id, capability AS cap, round(w * {_REL}, 6) AS val FROM routed")
def late_fusion(spark, folder):
    return scoring.late_fusion(_related(spark, folder)).select("id", "cap", F.round("val", 6).alias("val"))


@register("u1b_sparse_fusion", f"WITH {_ROUTE} SELECT vec_id AS id, list(capability ORDER BY capability) AS caps FROM routed WHERE w * {_REL} > 0 GROUP BY vec_id")
def sparse_fusion(spark, folder):
    some = scoring.late_fusion(_related(spark, folder)).where("val > 0")
    return some.groupBy("id").agg(F.array_sort(F.collect_list("cap")).alias("caps"))


_PDM = "l AS (SELECT vec_id, capability, 1.0 AS base, greatest(0, 1 - w) AS cond FROM routed), dv AS (SELECT *, base - cond AS dev FROM l), st AS (SELECT capability, avg(dev) AS mu, greatest(stddev_pop(dev), 1e-6) AS sd FROM dv GROUP BY capability)"


@register("u2b_dry_run", f"WITH {_ROUTE}, {_PDM} SELECT vec_id AS id, capability AS cap, round(greatest(0, 1 / (1 + exp(-(dev - mu) / sd)) * (1 - 1 / (1 + exp(-(cond - 3))))), 5) AS val FROM dv JOIN st USING (capability)")
def dry_run(spark, folder):
    scores = routed(spark, folder).select(F.col("vec_id").alias("id"), F.col("capability").alias("cap"), F.col("weight").alias("val"))
    return scoring.deviation_gain(scoring.dry_run_losses(scores)).select("id", "cap", F.round("val", 5).alias("val"))


_LOSS = "dv AS (SELECT event_id, user_id % 5 AS cap, value / 20 AS cond, value / 25 + 0.5 AS base, value / 25 + 0.5 - value / 20 AS dev FROM events), st AS (SELECT cap, avg(dev) AS mu, greatest(stddev_pop(dev), 1e-6) AS sd FROM dv GROUP BY cap)"


@register("u2_deviation_gain", f"WITH {_LOSS} SELECT event_id AS id, cap, round(greatest(0, 1 / (1 + exp(-(dev - mu) / sd)) * (1 - 1 / (1 + exp(-(cond - 3))))), 5) AS val FROM dv JOIN st USING (cap)")
def deviation_gain(spark, folder):
    """Losses with and without context that stand in for a model's."""
    losses = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("cap"), (F.col("value") / 25 + 0.5).alias("base"), (F.col("value") / 20).alias("cond"))
    return scoring.deviation_gain(losses).select("id", "cap", F.round("val", 5).alias("val"))


@register("u2c_active_set", f"WITH {_ROUTE} SELECT vec_id AS id, list(capability ORDER BY rank)[1:2] AS active FROM routed GROUP BY vec_id")
def active_set(spark, folder):
    r = routed(spark, folder).groupBy(F.col("vec_id").alias("id")).agg(F.collect_list(F.struct(F.col("capability").alias("cap"), F.col("weight").alias("val"))).alias("s"), F.collect_list("capability").alias("k"))
    return r.select("id", scoring.active(F.col("s"), F.col("k"), "scored", 2).alias("active"))


@register("u3_delta", f"WITH {_ROUTE}, d AS (SELECT doc_id, sum((quality + 1) * (toxic + 2)) AS delta FROM labels GROUP BY doc_id) SELECT vec_id AS id, capability AS cap, round(delta * w, 5) AS val FROM routed JOIN d ON d.doc_id = vec_id")
def delta(spark, folder):
    """Complexity times quality summed over turns, spread by routing weights."""
    d = table(spark, folder, "labels").groupBy(F.col("doc_id").alias("vec_id")).agg(F.sum((F.col("quality") + 1) * (F.col("toxic") + 2)).alias("delta"))
    r = routed(spark, folder).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "capability", "weight"))).alias("r"))
    j = r.join(d, "vec_id").select(F.col("vec_id").alias("id"), F.transform("r", lambda x: x["capability"]).alias("caps"), scoring.spread(F.col("delta").cast("double"), F.transform("r", lambda x: x["weight"])).alias("vals"))
    return j.select("id", F.explode(F.arrays_zip("caps", "vals")).alias("x")).select("id", F.col("x.caps").alias("cap"), F.round("x.vals", 5).alias("val"))


@register("u3b_turn_scores", "SELECT conv_id, list(length(text) ORDER BY turn) AS score FROM conversations GROUP BY conv_id")
def turn_scores(spark, folder):
    g = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("s"))
    return g.select("conv_id", F.transform("s", lambda x: x["n"]).alias("score"))


@register("u4_cluster_delta", "SELECT conv_id, turn % 3 AS cap, CAST(sum(length(text) * (turn + 1)) AS BIGINT) AS val FROM conversations GROUP BY conv_id, turn % 3")
def cluster_delta(spark, folder):
    c = table(spark, folder, "conversations")
    return c.groupBy("conv_id", (F.col("turn") % 3).alias("cap")).agg(F.sum(F.length("text") * (F.col("turn") + 1)).alias("val"))


@register("u4b_all_clusters", "SELECT conv_id, CAST(c AS INT) AS cap, CAST(sum(length(text) + c) AS BIGINT) AS val FROM conversations, range(3) t(c) GROUP BY conv_id, c")
def all_clusters(spark, folder):
    """Every cluster for every turn, as an array beside the row."""
    c = table(spark, folder, "conversations").select("conv_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.length("text") + i)).alias("cap", "x"))
    return c.groupBy("conv_id", "cap").agg(F.sum("x").alias("val"))


@register("u5_judge_vector", f"WITH {_ROUTE} SELECT vec_id AS id, capability AS cap, round(coalesce(quality, 0) * w, 6) AS val FROM routed LEFT JOIN labels ON doc_id = vec_id")
def judge_vector(spark, folder):
    """1 or 0 of a judge's reply, spread by routing weights; rows without a reply get zeros."""
    reply = texts.judge_reply(F.when(F.col("quality") == 1, "yes||x").otherwise("no||y"))
    judged = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), reply["judge_score"].alias("j"))
    return routed(spark, folder).join(judged, "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("capability").alias("cap"), F.round(F.coalesce("j", F.lit(0.0)) * F.col("weight"), 6).alias("val"))


@register("u6_context_score", "SELECT l_partkey AS demo, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS score FROM lineitem GROUP BY l_partkey")
def context_score(spark, folder):
    """Metric of a prediction weighted by the attention to each demo."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("demo")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("score"))


@register("u7_recipe_score", f"WITH {VECTORS_SQL} SELECT vec_id AS id, round(0.7 * (0.4 * v[1] + 0.3 * v[2] + 0.2 * v[3] + 0.1 * v[4]) + 0.3 * (v[5] + 1) / 2, 6) AS score FROM e")
def recipe_score(spark, folder):
    u = read_vectors(spark, folder).select(F.col("vec_id").alias("id"), F.slice("v", 1, 4).alias("u"), F.col("v")[4].alias("reward"))
    return scoring.recipe_score(u, [0.4, 0.3, 0.2, 0.1], 0.7, 0.3).select("id", F.round("score", 6).alias("score"))


_REWARD = CENTROIDS_SQL + ", b AS (SELECT label, (label + 1) / 55.0::DOUBLE AS w FROM c), r AS (SELECT e.vec_id, sum(b.w * list_cosine_similarity(e.v, c.c)) / sum(b.w) AS reward FROM e, unnest([e.label, (e.label + 1) % 10]) t(cap) JOIN c ON c.label = cap JOIN b ON b.label = cap GROUP BY e.vec_id)"


def _rewards(spark, folder):
    v = read_vectors(spark, folder)
    anchors = routing.centroids(v, "label", "v").select(F.col("label").alias("cap"), F.col("c").alias("g"))
    beta = anchors.select("cap", ((F.col("cap") + 1) / 55).alias("w"))
    rows = v.select(F.col("vec_id").alias("id"), "v", F.array(F.col("label"), (F.col("label") + 1) % 10).alias("caps"))
    return scoring.anchor_reward(rows, anchors, beta)


@register("u8_anchor_reward", f"WITH {_REWARD} SELECT vec_id AS id, round(reward, 6) AS reward FROM r")
def anchor_reward(spark, folder):
    return _rewards(spark, folder).select("id", F.round("reward", 6).alias("reward"))


@register("u8b_own_anchor", f"WITH {CENTROIDS_SQL}, m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(c[i]) AS a FROM c, range(1, 65) t(i) WHERE label < 8 GROUP BY i)) SELECT vec_id AS id, round(list_cosine_similarity(v, coalesce(c.c, m.m)), 6) AS reward FROM e LEFT JOIN c ON c.label = e.label AND c.label < 8 CROSS JOIN m")
def own_anchor(spark, folder):
    """To the row's own anchor, else to the mean of all anchors. Anchors are a row a capability."""
    v = read_vectors(spark, folder)
    anchors = routing.centroids(v, "label", "v").where("label < 8").select("label", "c")
    mean = routing.centroids(anchors.select(F.lit(0).alias("g"), "c"), "g", "c").select(F.col("c").alias("m"))
    j = v.join(F.broadcast(anchors), "label", "left").join(F.broadcast(mean))
    return j.select(F.col("vec_id").alias("id"), F.round(vectors.cosine(F.col("v"), F.coalesce("c", "m")), 6).alias("reward"))


@register("u9_keep_mask", f"WITH {VECTORS_SQL}, b AS (SELECT vec_id AS id, vec_id // 16 AS batch, round(v[1], 6) AS s FROM e), p AS (SELECT *, 1 / (1 + exp(-(s - avg(s) OVER w) / greatest(stddev_pop(s) OVER w, 1e-6))) >= 0.5 AS k FROM b WINDOW w AS (PARTITION BY batch)) SELECT id, k OR (NOT bool_or(k) OVER (PARTITION BY batch) AND row_number() OVER (PARTITION BY batch ORDER BY s DESC, id) = 1) AS keep FROM p")
def keep_mask(spark, folder):
    b = read_vectors(spark, folder).select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 16).alias("batch"), F.round(F.col("v")[0], 6).alias("s"))
    return scoring.keep_mask(b, "batch", "s", "id").select("id", "keep")


@register("u10_alpha_updates")
def alpha_updates(spark, folder):
    """Method weights after each of four batches."""
    u = read_vectors(spark, folder).select("vec_id", F.slice("v", 1, 4).alias("u"), F.col("v")[4].alias("reward"))
    state, rows = scoring.AlphaState([0.25] * 4), []
    for batch in range(4):
        state.update(*scoring.method_signal(u.where(F.col("vec_id") % 4 == batch)))
        rows += [(batch, k, round(a, 6)) for k, a in enumerate(state.alpha)]
    return spark.createDataFrame(rows, "batch int, method int, alpha double")


@register("u11_multiplicative", f"WITH {VECTORS_SQL}, u AS (SELECT i, avg(v[i] * v[5]) AS u FROM e, range(1, 5) t(i) GROUP BY i), r AS (SELECT i, 0.25 * exp(0.8 * u) AS r FROM u) SELECT CAST(i - 1 AS INT) AS method, round(0.95 * r / sum(r) OVER () + 0.0125, 6) AS alpha FROM r")
def multiplicative(spark, folder):
    batch = read_vectors(spark, folder).select(F.slice("v", 1, 4).alias("metrics"), F.col("v")[4].alias("reward"))
    alpha = scoring.multiplicative_update([0.25] * 4, scoring.utilities(batch), 0.8, 0.05)
    return spark.createDataFrame([(k, round(a, 6)) for k, a in enumerate(alpha)], "method int, alpha double")


@register("u11b_prototype_update", f"WITH {VECTORS_SQL}, u AS (SELECT i, avg(v[i] * v[5]) AS u FROM e, range(1, 5) t(i) GROUP BY i), r AS (SELECT i, exp(0.8 * (u - avg(u) OVER ())) AS r FROM u), m AS (SELECT i, greatest(0.125 + 0.5 * r / sum(r) OVER (), 0.05) AS m FROM r) SELECT CAST(i - 1 AS INT) AS method, round(0.95 * m / sum(m) OVER () + 0.0125, 6) AS alpha FROM m")
def prototype_update(spark, folder):
    """Centred utilities, averaged over time, through a softmax with step size, floor and mixing."""
    batch = read_vectors(spark, folder).select(F.slice("v", 1, 4).alias("metrics"), F.col("v")[4].alias("reward"))
    u = scoring.utilities(batch)
    centred = [x - sum(u) / len(u) for x in u]
    target = scoring.softmax([0.8 * x for x in centred])
    mixed = [0.5 * 0.25 + 0.5 * t for t in target]
    final = scoring.normalized_weights([max(m, 0.05) for m in mixed], 4)
    return spark.createDataFrame([(k, round(0.95 * a + 0.05 / 4, 6)) for k, a in enumerate(final)], "method int, alpha double")


@register("u11c_batch_weights", f"WITH {VECTORS_SQL}, s AS (SELECT vec_id AS id, vec_id // 20 AS batch, round(0.4 * v[1] + 0.6 * v[2], 6) AS s FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY s DESC, id) AS r, count(*) OVER (PARTITION BY batch) AS n FROM s), c AS (SELECT id, batch, s, min(s) OVER (PARTITION BY batch) AS m FROM k WHERE r <= ceil(n * 0.5)), p AS (SELECT id, batch, CASE WHEN m <= 0 THEN s - m + 1e-6 ELSE s END AS w FROM c) SELECT id, round(w / sum(w) OVER (PARTITION BY batch), 5) AS weight FROM p")
def batch_weights(spark, folder):
    """The better half of each batch; weights are moved above 0 where one is not, and sum to 1."""
    s = read_vectors(spark, folder).select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 20).alias("batch"), F.round(0.4 * F.col("v")[0] + 0.6 * F.col("v")[1], 6).alias("s"))
    w = Window.partitionBy("batch")
    kept = s.withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), "id"))).withColumn("n", F.count("*").over(w)).where("r <= ceil(n * 0.5)")
    moved = kept.withColumn("m", F.min("s").over(w)).withColumn("w", F.when(F.col("m") <= 0, F.col("s") - F.col("m") + 1e-6).otherwise(F.col("s")))
    return moved.select("id", F.round(F.col("w") / F.sum("w").over(w), 5).alias("weight"))


@register("u12_loaded_weights", "SELECT CAST(i AS INT) AS i, CASE i WHEN 0 THEN 0.75 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 ELSE 0.0 END::DOUBLE AS w FROM range(4) t(i)")
def loaded_weights(spark, folder):
    return spark.createDataFrame(list(enumerate(scoring.normalized_weights([3.0, -1.0, 1.0], 4))), "i int, w double")


@register("u13_anchor_groups", "SELECT label AS cap, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5")
def anchor_groups(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.coalesce(F.when(F.col("label") % 2 == 0, F.col("label")), "label").alias("cap"), "vec_id")
    return ingest.top_of_each(rows, "cap", 5, F.col("vec_id")).select("cap", "vec_id")


@register("u14_method_tensor", f"WITH {_ROUTE}, m AS (SELECT vec_id AS id, 0 AS method, capability AS cap, w AS val FROM routed UNION ALL SELECT vec_id, 1, capability, greatest(0, s) FROM routed), t AS (SELECT id, cap, sum(val) AS t FROM m GROUP BY id, cap) SELECT id, cap, round(t, 5) AS total FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(t, 9) DESC, cap) <= 2")
def method_tensor(spark, folder):
    """Capabilities with the largest sums over methods, for rows without a routing of their own."""
    r = routed(spark, folder)
    long = r.select(F.col("vec_id").alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("method"), F.col("capability").alias("cap"), F.col("weight").alias("val")), F.struct(F.lit(1).alias("method"), F.col("capability").alias("cap"), F.greatest(F.lit(0.0), F.col("similarity")).alias("val")))).alias("m"))
    t = long.groupBy("id", "m.cap").agg(F.sum("m.val").alias("t"))
    return ingest.top_of_each(t, "id", 2, F.desc(F.round("t", 9)), F.col("cap")).select("id", "cap", F.round("t", 5).alias("total"))


@register("u15_equal_shares", f"WITH {_ROUTE} SELECT vec_id AS id, capability AS cap, round(quality / 3.0::DOUBLE, 6) AS val FROM routed JOIN labels ON doc_id = vec_id")
def equal_shares(spark, folder):
    l = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    r = routed(spark, folder).groupBy("vec_id").agg(F.collect_list("capability").alias("caps")).join(l, "vec_id")
    each = F.explode(F.transform("caps", lambda c: F.struct(c.alias("cap"), (F.col("quality") / F.size("caps")).alias("val"))))
    return r.select(F.col("vec_id").alias("id"), each.alias("x")).select("id", "x.cap", F.round("x.val", 6).alias("val"))


@register("u16_four_metric", "SELECT event_id, round(greatest(0, least(5, value / 10)) / 5 * 0.98 + 0.01, 6) AS metric FROM events")
def four_metric(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(scoring.four_metric(F.col("value") / 10), 6).alias("metric"))


@register("u17_response_loss", "SELECT conv_id, round(avg(length(text)) FILTER (role = 'assistant'), 6) AS loss FROM conversations GROUP BY conv_id")
def response_loss(spark, folder):
    """Mean loss over responses alone; their length stands in for a model's loss."""
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.when(F.col("role") == "assistant", F.length("text"))), 6).alias("loss"))


@register("u17b_token_loss", r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, turn, unnest(w) AS w FROM t) SELECT conv_id, turn, round(avg(length(w)), 6) AS loss FROM p GROUP BY conv_id, turn")
def token_loss(spark, folder):
    """Mean loss over the tokens of a response after its prompt: a model of one's own gives each token a loss."""
    turns = table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.lit("### Response:").alias("prompt"), F.coalesce("text", F.lit("")).alias("response"))
    found = models.response_loss(turns, "prompt", "response", lambda tokens: [float(len(t)) for t in tokens])
    return found.where("loss is not null").select("conv_id", "turn", F.round("loss", 6).alias("loss"))


@register("u19_profiles", "SELECT doc_id, coalesce('Handles ' || lang || ' text', 'General capability.') AS profile FROM documents")
def profiles(spark, folder):
    """One paragraph a sample of a model's reply, a default where there is none."""
    reply = F.concat(F.lit("CDT_Description: Handles "), F.col("lang"), F.lit("   text"))
    return table(spark, folder, "documents").select("doc_id", texts.description(F.regexp_replace(reply, "^CDT_", ""), "General capability.").alias("profile"))


@register("u19b_batched_profiles", "SELECT doc_id, lang AS tags FROM documents")
def batched_profiles(spark, folder):
    """Replies that hold several samples by id, taken apart."""
    d = table(spark, folder, "documents").select(F.floor(F.col("doc_id") / 5).alias("b"), F.col("doc_id").cast("string").alias("id"), F.struct(F.col("lang").alias("tags")).alias("p"))
    reply = d.groupBy("b").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "p")))).alias("reply"))
    return reply.select(F.explode(F.from_json("reply", "map<string,struct<tags:string>>")).alias("id", "p")).select(F.col("id").cast("long").alias("doc_id"), "p.tags")


@register("u20_cluster_names", "WITH w AS (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: length(x) > 4)) AS w FROM documents), n AS (SELECT lang, w, count(*) AS n FROM w GROUP BY lang, w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) <= 2) SELECT lang, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY n DESC, w) || ' Capability' AS name FROM n GROUP BY lang")
def cluster_names(spark, folder):
    """Fallback names: the two most frequent tokens of a cluster."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.length(w) > 4)
    n = table(spark, folder, "documents").select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = ingest.top_of_each(n, "lang", 2, F.desc("n"), F.col("w")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank_in_group", F.initcap("w").alias("w")))).alias("t"))
    return top.select("lang", F.concat(F.array_join(F.transform("t", lambda x: x["w"]), " "), F.lit(" Capability")).alias("name"))


@register("u21_intent_tags", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN [] ELSE [lang, 'x'] END AS tags FROM documents")
def intent_tags(spark, folder):
    """Tags of a model's reply; a reply that is an error keeps none."""
    reply = F.when(F.col("doc_id") % 7 == 0, "error").otherwise(F.concat(F.lit('["'), F.col("lang"), F.lit('", "X"]')))
    return table(spark, folder, "documents").select("doc_id", texts.json_tags(reply).alias("tags"))


@register("u22_point_scores", "SELECT d.doc_id, CASE WHEN lang IN ('fr', 'es') THEN ['romance'] ELSE [lang] END AS labels, coalesce(CAST(quality AS DOUBLE), 0) AS score FROM documents d LEFT JOIN labels USING (doc_id)")
def point_scores(spark, folder):
    """Labels by the merge map, and the scalar of another scorer."""
    merged = F.create_map(F.lit("fr"), F.lit("romance"), F.lit("es"), F.lit("romance"))
    j = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return j.select("doc_id", F.array_distinct(F.array(F.coalesce(F.element_at(merged, F.col("lang")), "lang"))).alias("labels"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("score"))


@register("u23_four_aspects", "SELECT event_id, round(greatest(0, least(5, value / 12)) / 5 * 0.98 + 0.01, 6) AS relevance FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 9 = 0")
def four_aspects(spark, folder):
    """Aspects of a judge's reply, scaled; failed replies are blank."""
    reply = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise((F.col("value") / 12).cast("string"))
    return table(spark, folder, "events").select("event_id", F.round(scoring.four_metric(reply.try_cast("double")), 6).alias("relevance")).withColumn("relevance", F.when(F.col("event_id") % 9 != 0, F.col("relevance")))
