"""Queries of the scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rouge, texts, vectors
from lodestone.plans.registry import register
from lodestone.sources.tables import CENTROIDS_SQL, SAMPLES_SQL, VECTORS_SQL, samples, table
from lodestone.sources.tables import vectors as read_vectors


def _with_centroid(spark, folder):
    """Vectors beside their label's centroid (ten labels)."""
    v = read_vectors(spark, folder)
    centroids = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return v.join(F.broadcast(centroids), "label")


@register("x1_cosine", f"WITH {CENTROIDS_SQL} SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS cosine FROM e JOIN c USING (label)")
def cosine(spark, folder):
    return _with_centroid(spark, folder).select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("c")), 6).alias("cosine"))


@register("x2_normalize", f"WITH {VECTORS_SQL} SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l1 FROM e")
def normalize(spark, folder):
    unit = vectors.normalized(F.col("v"))
    return read_vectors(spark, folder).select("vec_id", F.round(unit[0], 6).alias("first"), F.round(vectors.total(F.transform(unit, F.abs)), 6).alias("l1"))


@register("x3_euclidean", f"WITH {CENTROIDS_SQL} SELECT vec_id, round(list_distance(v, c), 6) AS distance FROM e JOIN c USING (label)")
def euclidean(spark, folder):
    return _with_centroid(spark, folder).select("vec_id", F.round(vectors.euclidean(F.col("v"), F.col("c")), 6).alias("distance"))


@register("x4_softmax", f"WITH {VECTORS_SQL}, r AS (SELECT vec_id, list_transform(v[1:8], lambda x: exp(x / 0.5)) AS r FROM e) SELECT vec_id, i, round(r[i] / list_sum(r), 6) AS weight FROM r, range(1, 9) t(i)")
def softmax(spark, folder):
    weights = vectors.softmax(F.slice("v", 1, 8), 0.5)
    return read_vectors(spark, folder).select("vec_id", F.posexplode(weights).alias("i", "w")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("w", 6).alias("weight"))


@register("x5_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS s FROM events")
def sigmoid(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(vectors.sigmoid((F.col("value") - 50) / 10), 6).alias("s"))


@register("x6_hash_embedding")
def hash_embedding(spark, folder):
    """Of whole texts; crc32 has no counterpart in the SQL of the check, so the tests compare with a plain loop."""
    return table(spark, folder, "documents").select("doc_id", F.transform(vectors.hash_embedding(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


@register("x7_tf_idf_hashing")
def hashed_tf_idf(spark, folder):
    """Murmur3 hashing into 256 places and inverse document frequency: the place with the largest weight of each text."""
    docs = table(spark, folder, "documents").select("doc_id", F.explode(texts.words(F.coalesce("text", F.lit("")))).alias("w"))
    counts = docs.groupBy("doc_id", F.pmod(F.hash("w"), F.lit(256)).alias("place")).agg(F.count("*").alias("tf"))
    n = table(spark, folder, "documents").count()
    idf = counts.groupBy("place").agg((F.log((n + 1) / (F.count("*") + 1)) + 1).alias("idf"))  # 256 rows
    weighed = counts.join(idf, "place").withColumn("weight", F.col("tf") * F.col("idf"))
    return weighed.groupBy("doc_id").agg(F.max_by("place", F.struct("weight", "place")).alias("place"), F.round(F.max("weight"), 6).alias("weight"))


_STOP = ", ".join(f"'{w}'" for w in texts.STOP_WORDS)


@register("x8_keywords", f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: w NOT IN ({_STOP}))) AS INT) AS n, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: w NOT IN ({_STOP}))[1] AS first FROM documents")
def keywords(spark, folder):
    found = texts.keyword_tokens(F.coalesce("text", F.lit("")))
    return table(spark, folder, "documents").select("doc_id", found.alias("k")).select("doc_id", F.size("k").alias("n"), F.get("k", F.lit(0)).alias("first"))


@register("x8b_words", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9_]+')) AS INT) AS n FROM documents")
def words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(texts.words(F.coalesce("text", F.lit("")))).alias("n"))


@register("x9_rouge_l")
def rouge_l(spark, folder):
    """Of each sample's output against its input, by longest common subsequence."""
    return samples(spark, folder).select("doc_id", F.round(rouge.rouge_l_f1(F.col("output"), F.col("input")), 6).alias("rouge_l"))


@register("x10_metric_text", r"""SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS lowered,
  array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS squad FROM documents""")
def metric_text(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", texts.metric_text(t, "lower_strip").alias("lowered"), texts.metric_text(t, "squad").alias("squad"))


@register("x11_exact_match", f"WITH {SAMPLES_SQL} SELECT doc_id, CAST(lower(trim(regexp_replace(instruction, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(output, '\\s+', ' ', 'g'))) AS INT) AS matched FROM s")
def exact_match(spark, folder):
    return samples(spark, folder).select("doc_id", (texts.metric_text(F.col("instruction"), "lower_strip") == texts.metric_text(F.col("output"), "lower_strip")).cast("int").alias("matched"))


@register("x13_digit_score", r"SELECT event_id, coalesce(CAST(nullif(regexp_extract(' ' || props || ' ', '[^0-9]([1-6])[^0-9]', 1), '') AS DOUBLE), 3.0) AS score FROM events")
def digit_score(spark, folder):
    return table(spark, folder, "events").select("event_id", texts.digit_score(F.col("props")).alias("score"))


@register("x13b_expected_score", "WITH w AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:6], lambda x: exp(x)) AS w FROM embeddings) SELECT vec_id, round((w[1] + 2 * w[2] + 3 * w[3] + 4 * w[4] + 5 * w[5] + 6 * w[6]) / list_sum(w), 6) AS score FROM w")
def expected_score(spark, folder):
    return read_vectors(spark, folder).select("vec_id", F.round(texts.expected_score([F.col("v")[i] for i in range(6)]), 6).alias("score"))


@register("x14_batch_scores", r"WITH n AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(source, ''), 'c'), lambda x: TRY_CAST(x AS INT)), lambda x: x BETWEEN 1 AND 6) AS k FROM documents) SELECT doc_id, coalesce(CAST(k[1] AS DOUBLE), 3.0) AS first, 3.0::DOUBLE AS second, CAST(2 AS INT) AS n FROM n")
def batch_scores(spark, folder):
    scores = texts.batch_scores(F.split(F.coalesce("source", F.lit("")), "c"), F.lit(2))
    return table(spark, folder, "documents").select("doc_id", scores[0].alias("first"), scores[1].alias("second"), F.size(scores).alias("n"))


@register("x15_judge_reply", "SELECT doc_id, quality = 1 AS judge_pass, CAST(quality AS DOUBLE) AS judge_score, 'toxic ' || CAST(toxic AS VARCHAR) AS judge_reason FROM labels")
def judge_reply(spark, folder):
    reply = F.concat(F.when(F.col("quality") == 1, " Yes").otherwise("no"), F.lit("|| toxic "), F.col("toxic"), F.lit(" "))
    return table(spark, folder, "labels").select("doc_id", texts.judge_reply(reply).alias("r")).select("doc_id", "r.*")


@register("x16_json_tags", "SELECT doc_id, CASE WHEN source = lang THEN [lang] ELSE [lang, source] END AS tags FROM documents")
def json_tags(spark, folder):
    reply = F.concat(F.lit('Here: ```json\n{"tags": [" '), F.upper("lang"), F.lit('", "'), F.col("source"), F.lit('", "'), F.col("lang"), F.lit('"]}\n```'))
    return table(spark, folder, "documents").select("doc_id", texts.json_tags(reply).alias("tags"))


@register("x18_json_object", "SELECT doc_id, 'toxic' AS k, CAST(toxic AS VARCHAR) AS v FROM labels")
def json_object(spark, folder):
    reply = F.concat(F.lit("Sure.\n```json\n"), F.to_json(F.struct("toxic")), F.lit("\n``` done"))
    found = F.explode(F.from_json(texts.json_object(reply), "map<string,string>"))
    return table(spark, folder, "labels").select("doc_id", found.alias("k", "v"))


@register("x19_tag_list", "SELECT doc_id, [lang, source] AS tags FROM documents")
def tag_list(spark, folder):
    raw = F.concat(F.col("lang"), F.lit(" ，"), F.upper("lang"), F.lit(";/ "), F.col("source"), F.lit("|"))
    return table(spark, folder, "documents").select("doc_id", texts.tag_list(raw).alias("tags"))


@register("x20_description", r"WITH d AS (SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:50], ' ') AS t FROM documents WHERE lang = 'en') SELECT doc_id, CASE WHEN t = '' THEN 'none' ELSE t END AS description FROM d")
def description(spark, folder):
    return table(spark, folder, "documents").where("lang = 'en'").select("doc_id", texts.description(F.concat(F.lit("T_description : "), F.col("text")), "none").alias("description"))


@register("x21_clip", r"WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END AS clipped FROM t")
def clip(spark, folder):
    return table(spark, folder, "documents").select("doc_id", texts.clipped(F.col("text"), 40).alias("clipped"))


@register("x22_humanize", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_brand || '-' || p_type, '[_-]', ' ', 'g'), '[^A-Za-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def humanize(spark, folder):
    return table(spark, folder, "part").select("p_partkey", texts.humanized(F.concat_ws("-", "p_brand", "p_type")).alias("name"))


@register("x23_topic_map", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN '英语' WHEN 'de' THEN '德语' WHEN 'fr' THEN '法语' WHEN 'es' THEN '西班牙语' ELSE lang END AS topic FROM documents")
def topic_map(spark, folder):
    names = F.create_map(*[F.lit(x) for pair in {"en": "英语", "de": "德语", "fr": "法语", "es": "西班牙语"}.items() for x in pair])
    return table(spark, folder, "documents").select("lang").distinct().select("lang", F.coalesce(F.element_at(names, F.col("lang")), "lang").alias("topic"))


@register("x24_last_line", r"SELECT doc_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')[-1], '') AS line FROM documents")
def last_line(spark, folder):
    return table(spark, folder, "documents").select("doc_id", texts.last_line(F.col("text")).alias("line"))


@register("x25_fallback_name", "SELECT doc_id, lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+')[1:6], ' ')) AS name FROM documents")
def fallback_name(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.lower(texts.fallback_name(F.col("text"))).alias("name"))


@register("x26_mean_pooling", f"WITH {VECTORS_SQL}, m AS (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) t(i) GROUP BY ALL) SELECT label, i, round(a / sqrt(sum(a * a) OVER (PARTITION BY label)), 6) AS x FROM m")
def mean_pooling(spark, folder):
    """Vectors as token embeddings of their label: their mean at unit length."""
    pooled = _with_centroid(spark, folder).select("label", "c").distinct()
    return pooled.select("label", F.posexplode(vectors.normalized(F.col("c"))).alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@register("x27_warmup_scale", "SELECT event_id, CASE WHEN event_id <= 100 THEN event_id / 100.0::DOUBLE ELSE greatest(0, (5000 - event_id) / 4900.0::DOUBLE) END AS scale FROM events WHERE event_id > 0")
def warmup_scale(spark, folder):
    return table(spark, folder, "events").where("event_id > 0").select("event_id", texts.warmup_scale(F.col("event_id"), 100, 5000).alias("scale"))


@register("x28_logprob_shapes", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS logprob FROM events")
def logprob_shapes(spark, folder):
    """Log-probabilities given as an object or as a list of objects: both read into one map."""
    as_list = F.concat(F.lit('[{"token": "k", "logprob": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    shape = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(as_list)
    listed = F.from_json(shape, "array<struct<token:string,logprob:double>>")
    both = F.when(shape.startswith("["), F.map_from_entries(F.transform(listed, lambda s: F.struct(s["token"], s["logprob"])))).otherwise(F.from_json(shape, "map<string,double>"))
    return table(spark, folder, "events").select("event_id", F.element_at(both, "k").alias("logprob"))


@register("x29_first_answer", f"WITH {SAMPLES_SQL} SELECT doc_id, regexp_replace(instruction, '^\\s+|\\s+$', '', 'g') AS answer FROM s WHERE instruction <> ''")
def first_answer(spark, folder):
    made = F.concat(F.lit("### Response:\n Answer : "), F.col("instruction"), F.lit("\nmore"))
    return samples(spark, folder).where("instruction <> ''").select("doc_id", texts.first_answer(texts.after_marker(made, "### Response:")).alias("answer"))


@register("x31_safe_name", r"SELECT page_id, CASE WHEN n = '' THEN 'run' ELSE n END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM pages)")
def safe_name(spark, folder):
    return table(spark, folder, "pages").select("page_id", texts.safe_name(F.col("url")).alias("name"))


@register("x33_lowered_tags", "SELECT DISTINCT p_brand, lower(p_brand) AS tag FROM part")
def lowered_tags(spark, folder):
    return table(spark, folder, "part").select("p_brand", F.explode(texts.lowered_tags(F.array(F.concat(F.lit(" "), F.col("p_brand")), F.upper("p_brand")))).alias("tag")).distinct()
