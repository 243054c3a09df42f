"""Queries of streams and of what surrounds models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import texts
from lodestone.operators import models
from lodestone.operators.scoring import AlphaState
from lodestone.plans.registry import register
from lodestone.sources.tables import SAMPLES_SQL, samples, scratch, table
from lodestone.streaming import recipe


@register("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, folder):
    stream = recipe.windowed_counts(recipe.read_events(spark, folder))
    return recipe.finished(stream, scratch(spark)).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_running_counts", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id")
def running_counts(spark, folder):
    return recipe.finished(recipe.running_counts(recipe.read_events(spark, folder)), scratch(spark))


@register("stream_recipe")
def stream_recipe(spark, folder):
    """Method weights after each micro-batch of events."""
    history: list[tuple] = []
    values = [F.col("value") / 100, F.col("user_id") % 10 / 10, F.lit(0.5)]
    batches = recipe.read_events(spark, folder).select(F.array(*values).alias("u"), (F.col("value") / 50 - 1).alias("reward"))
    recipe.run_recipe(batches, AlphaState([1 / 3] * 3), scratch(spark), lambda number, alpha: history.extend((number, k, round(a, 6)) for k, a in enumerate(alpha)))
    return spark.createDataFrame(history, "batch int, method int, alpha double")


@register("x17_relations", "SELECT doc_id, CASE WHEN quality = 1 THEN 'strongly related' ELSE 'weakly related' END AS first, 'unrelated' AS second FROM labels")
def relations(spark, folder):
    word = F.when(F.col("quality") == 1, "Strongly related").otherwise("weakly")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('```json {"relations": [{"rank": 0, "relation": "'), word, F.lit('"}]}```'))).otherwise(F.concat(F.lit('["'), word, F.lit('"]')))
    found = table(spark, folder, "labels").select("doc_id", models.relations_of(reply, 2).alias("r"))
    return found.select("doc_id", F.col("r")[0].alias("first"), F.col("r")[1].alias("second"))


@register("x30_embedder", "SELECT n_nationkey, CAST(length(n_name) AS DOUBLE) AS first FROM nation")
def embedder(spark, folder):
    """A model of one's own in place of the trigram hash."""
    lengths = lambda s: pd.Series([[float(len(x))] for x in s])
    return models.embed(table(spark, folder, "nation"), "n_name", lengths).select("n_nationkey", F.col("embedding")[0].alias("first"))


@register("x32_gradients", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: x * x))), 6) AS first FROM embeddings")
def gradients(spark, folder):
    v = F.col("embedding").cast("array<double>")
    g = models.gradient(F.array(F.slice(v, 1, 16), F.slice(v, 17, 48)), 32)
    return table(spark, folder, "embeddings").select("vec_id", F.round(g[0], 6).alias("first"))


@register("p31_demos_in_budget", "SELECT vec_id, CASE WHEN vec_id % 40 + 10 <= 40 THEN CASE WHEN vec_id % 40 + 30 <= 40 THEN 3 ELSE CASE WHEN vec_id % 40 + 20 <= 40 THEN 2 ELSE 1 END END ELSE 1 END::INT AS n FROM embeddings")
def demos_in_budget(spark, folder):
    """Three demos of ten tokens beside queries of up to forty, in a budget of forty."""
    demos, sizes = F.array(*[F.lit(c) for c in "abc"]), F.array(*[F.lit(10).cast("long")] * 3)
    return table(spark, folder, "embeddings").select("vec_id", F.size(models.demos_in_budget(demos, sizes, F.col("vec_id") % 40, 40)).alias("n"))


@register("p32_loss_window", f"WITH {SAMPLES_SQL}, t AS (SELECT doc_id, regexp_extract_all(instruction, '\\S+') AS p, regexp_extract_all(output, '\\S+') AS o FROM s), w AS (SELECT doc_id, p, CASE WHEN len(o) < 2 THEN list_append(o, '</s>') ELSE o END AS o FROM t) SELECT doc_id, CAST(least(12, len(o) + least(len(p), greatest(0, 12 - len(o)))) AS INT) AS n, o[1] AS first_target FROM w")
def loss_window(spark, folder):
    s = samples(spark, folder)
    split = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    target = split(F.col("output"))
    window = models.loss_window(split(F.col("instruction")), target, 12, F.lit("</s>"))
    return s.select("doc_id", F.size(window).alias("n"), F.when(F.size(target) > 0, F.get(target, F.lit(0))).otherwise("</s>").alias("first_target"))


@register("f10_complete_runs", "SELECT event_type, count(*) FILTER (value IS NULL) = 0 AS complete FROM events GROUP BY event_type")
def complete_runs(spark, folder):
    """A guard: runs that hold what an interrupted one would lack."""
    return table(spark, folder, "events").groupBy("event_type").agg((F.count_if(F.col("value").isNull()) == 0).alias("complete"))


@register("f13_first_samples", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 64")
def first_samples(spark, folder):
    """The cap on samples that a run inserts."""
    return table(spark, folder, "documents").select("doc_id").orderBy("doc_id").limit(64)


@register("x12_language_routed", "SELECT doc_id, CASE WHEN regexp_matches(text, '[㐀-䶿一-鿿]') THEN 'zh' ELSE 'en' END AS model FROM documents")
def language_routed(spark, folder):
    """Which language's model scores a text: by its characters."""
    return table(spark, folder, "documents").select("doc_id", F.when(texts.has_cjk(F.coalesce("text", F.lit(""))), "zh").otherwise("en").alias("model"))


@register("x12b_routed_scores", "SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '[㐀-䶿一-鿿]') THEN 'zh' ELSE 'en' END AS language, CAST(length(coalesce(text, '')) % 10 AS DOUBLE) / 10 AS score FROM conversations")
def routed_scores(spark, folder):
    """Scores of a model of one's own for each language."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    score = lambda predictions, references: references.str.len() % 10 / 10.0
    return models.score_pairs(rows, "text", "text", {"en": score, "zh": score}).select("conv_id", "turn", "language", "score")


@register("a31_attention_weights", "WITH a AS (SELECT vec_id, list_transform(range(2), lambda h: list_transform(range(4), lambda q: list_transform(range(4), lambda d: abs(CAST(embedding[h * 16 + q * 4 + d + 1] AS DOUBLE))))) AS a FROM embeddings), w AS (SELECT vec_id, (a[1][3][1] + a[1][4][1] + a[2][3][1] + a[2][4][1]) / 4 AS x, (a[1][3][2] + a[1][3][3] + a[1][4][2] + a[1][4][3] + a[2][3][2] + a[2][3][3] + a[2][4][2] + a[2][4][3]) / 8 AS y FROM a) SELECT vec_id, round(x / (x + y), 6) AS first, round(y / (x + y), 6) AS second FROM w")
def attention_weights(spark, folder):
    """Two heads over four tokens: the last two ask, the first, and the second with the third, are demos."""
    v = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    heads = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.slice(v, h * 16 + q * 4 + 1, F.lit(4))))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    found = table(spark, folder, "embeddings").select("vec_id", models.attention_weights(heads, span(2, 9), F.array(span(0, 1), span(1, 3))).alias("w"))
    return found.select("vec_id", F.round(F.col("w")[0], 6).alias("first"), F.round(F.col("w")[1], 6).alias("second"))


@register("s14_streamed_files", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def streamed_files(spark, folder):
    """Files read as a stream, a bounded number at a time."""
    path = scratch(spark)
    table(spark, folder, "documents").select("doc_id").repartition(4).write.parquet(path)
    rows = spark.readStream.schema("doc_id long").option("maxFilesPerTrigger", 1).parquet(path)
    return recipe.finished(rows, scratch(spark), "append").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
