"""Queries of projections (P) and filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import texts
from lodestone.operators import ingest
from lodestone.plans.registry import register
from lodestone.sources.tables import SAMPLES_SQL, samples, table

_WITH = ingest.WITH_INPUT.replace("\n", "' || chr(10) || '")
_WITHOUT = ingest.WITHOUT_INPUT.replace("\n", "' || chr(10) || '")
_NL = "chr(10)"
_BLOCKS = f"'### Instruction:' || {_NL} || {{i}} || {_NL} || {_NL} || CASE WHEN {{n}} <> '' THEN '### Input:' || {_NL} || {{n}} || {_NL} || {_NL} ELSE '' END || '### Response:' || {_NL} || {{o}}"
_BLOCKS = _BLOCKS.replace("{i}", "%(i)s").replace("{n}", "%(n)s").replace("{o}", "%(o)s")
_PLAIN = {"i": "instruction", "n": "input", "o": "output"}
_STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
_BARE = {k: _STRIP % v for k, v in _PLAIN.items()}
_FLAT = r"trim(regexp_replace(%s, '\s+', ' ', 'g'))"


@register("p1_training_text", f"WITH {SAMPLES_SQL} SELECT doc_id, md5((CASE WHEN input <> '' THEN '{_WITH}' ELSE '{_WITHOUT}' END) || {_BLOCKS % _PLAIN}) AS digest FROM s")
def training_text(spark, folder):
    text = ingest.training_text(F.col("instruction"), F.col("input"), F.col("output"))
    return samples(spark, folder).select("doc_id", F.md5(text.cast("binary")).alias("digest"))


@register("p2_first_user_message", "SELECT conv_id, coalesce(arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END), arg_min(text, turn)) AS instruction FROM conversations GROUP BY conv_id")
def first_user_message(spark, folder):
    mine = F.col("role") == "user"
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.coalesce(F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn"))), F.min_by("text", "turn")).alias("instruction"))


@register("p3_multiple_choice", "SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_name AS options, CASE p_size % 4 WHEN 0 THEN 'A. ' || p_brand WHEN 1 THEN 'B. ' || p_type WHEN 2 THEN 'C. ' || p_name ELSE '' END AS output FROM part")
def multiple_choice(spark, folder):
    choices = F.array("p_brand", "p_type", "p_name")
    return table(spark, folder, "part").select("p_partkey", ingest.options(choices).alias("options"), ingest.chosen(choices, F.col("p_size") % 4).alias("output"))


@register("p4_balanced", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) <= 20")
def balanced(spark, folder):
    return ingest.top_of_each(table(spark, folder, "documents").select("doc_id", "lang"), "lang", 20, ingest.hash_order("doc_id"), F.col("doc_id")).select("doc_id", "lang")


_P5_SQL = """WITH t AS (SELECT conv_id, turn, lower(trim(role)) AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE trim(text) <> ''),
u AS (SELECT conv_id, min(turn) AS first FROM t WHERE role IN ('user', 'human') GROUP BY conv_id),
j AS (SELECT t.*, first FROM t LEFT JOIN u USING (conv_id)),
o AS (SELECT conv_id, arg_min(text, turn) AS output, arg_min(role, turn) AS category FROM j WHERE role NOT IN ('user', 'human', 'system') AND turn > first GROUP BY conv_id),
y AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS input FROM j WHERE role = 'system' AND (first IS NULL OR turn < first) GROUP BY conv_id)
SELECT c.conv_id, t.text AS instruction, y.input, o.output, o.category, CASE WHEN t.text IS NULL THEN 'no_user_instruction' WHEN o.output IS NULL THEN 'no_assistant_output' ELSE 'kept' END AS skip
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u USING (conv_id) LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = u.first LEFT JOIN o ON o.conv_id = c.conv_id LEFT JOIN y ON y.conv_id = c.conv_id"""


@register("p5_conversations", _P5_SQL)
def conversations(spark, folder):
    return ingest.conversations_to_samples(table(spark, folder, "conversations"))


@register("p6_evolved", "WITH p AS (" + _P5_SQL + ") SELECT conv_id, CAST(conv_id AS VARCHAR) AS id, instruction, output, 'evol' AS category FROM p WHERE skip = 'kept'")
def evolved(spark, folder):
    kept = ingest.conversations_to_samples(table(spark, folder, "conversations")).where("skip = 'kept'")
    return kept.select("conv_id", F.col("conv_id").cast("string").alias("id"), "instruction", "output", F.lit("evol").alias("category"))


@register("p7_code_category", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'code_python' WHEN doc_id % 3 = 1 THEN 'code_' || lang ELSE 'other' END AS category FROM documents")
def code_category(spark, folder):
    d = table(spark, folder, "documents")
    target = F.when(F.col("doc_id") % 3 == 0, "x ```Python3\ny```").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```"), F.col("lang"), F.lit("\nz```"))).otherwise("no code")
    return d.select("doc_id", ingest.code_category(target, "other").alias("category"))


@register("p8_dialogue_topic", f"WITH {SAMPLES_SQL} SELECT doc_id, 'Summarize the dialogue.' AS instruction, instruction AS input, CASE WHEN trim(output) = '' THEN '__MISSING_TOPIC__' ELSE 'topic' END AS category FROM s")
def dialogue_topic(spark, folder):
    return samples(spark, folder).select("doc_id", F.lit("Summarize the dialogue.").alias("instruction"), F.col("instruction").alias("input"), F.when(texts.stripped(F.col("output")) == "", "__MISSING_TOPIC__").otherwise("topic").alias("category"))


@register("p9_context_response", f"WITH {SAMPLES_SQL} SELECT id, instruction AS instruction, input AS input, output AS output, category FROM s")
def context_response(spark, folder):
    raw = samples(spark, folder).select("id", "instruction", F.col("input").alias("context"), F.col("output").alias("response"), "category")
    return raw.select("id", "instruction", F.col("context").alias("input"), F.col("response").alias("output"), "category")


@register("p10_category_or_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE source END AS category FROM documents")
def category_or_fallback(spark, folder):
    raw = F.when(F.col("doc_id") % 4 == 0, " None ").when(F.col("doc_id") % 4 == 2, "NaN").otherwise(F.concat(F.lit(" "), F.col("source")))
    return table(spark, folder, "documents").select("doc_id", ingest.category_or(raw, "unknown").alias("category"))


@register("p11_dense_ids", "SELECT source, CAST(row_number() OVER (ORDER BY min(doc_id), source) - 1 AS INT) AS id, count(*) AS n FROM documents GROUP BY source")
def dense_ids(spark, folder):
    return ingest.dense_ids(table(spark, folder, "documents"), "source", "doc_id")


@register("p12_shuffled_options", "WITH o AS (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(CAST(p_partkey AS VARCHAR) || x)) AS r FROM part, unnest(['1' || p_brand, '2' || p_type, '3' || p_name, '4' || p_brand]) t(x)) SELECT p_partkey, chr(CAST(64 + max(CASE WHEN x[1] = '4' THEN r END) AS INT)) AS category FROM o GROUP BY p_partkey")
def shuffled_options(spark, folder):
    """Four options in the order of a hash; the correct one's letter is the category."""
    named = F.array(F.concat(F.lit("1"), "p_brand"), F.concat(F.lit("2"), "p_type"), F.concat(F.lit("3"), "p_name"), F.concat(F.lit("4"), "p_brand"))
    keyed = F.array_sort(F.transform(named, lambda x: F.struct(F.md5(F.concat(F.col("p_partkey").cast("string"), x).cast("binary")).alias("k"), x.alias("x"))))
    at = F.array_position(F.transform(keyed, lambda s: F.substring(s["x"], 1, 1)), "4")
    return table(spark, folder, "part").select("p_partkey", F.char(64 + at).alias("category"))


@register("p13_reasoning", "SELECT doc_id, lang AS question, source AS solution, [lang, source] AS thinking FROM documents")
def reasoning(spark, folder):
    nested = table(spark, folder, "documents").select("doc_id", F.struct("lang", "source").alias("raw"), F.array("lang", "source").alias("thinking"))
    return nested.select("doc_id", F.col("raw.lang").alias("question"), F.col("raw.source").alias("solution"), "thinking")


@register("p14_anchors", "WITH g AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 45), t AS (SELECT source FROM g ORDER BY md5(source || '|42'), source LIMIT 5), a AS (SELECT doc_id FROM documents JOIN t USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) <= 10) SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'train' ELSE 'anchor' END AS split FROM documents d LEFT JOIN a USING (doc_id)")
def anchors(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source")
    tasks = d.groupBy("source").count().where("count >= 45").orderBy(ingest.hash_order("source"), "source").limit(5)
    picked = ingest.top_of_each(d.join(F.broadcast(tasks.select("source")), "source", "left_semi"), "source", 10, ingest.hash_order("doc_id"), F.col("doc_id"))
    return d.join(picked.select("doc_id", F.lit("anchor").alias("split")), "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@register("p15_sample_text", f"WITH {SAMPLES_SQL} SELECT doc_id, md5(array_to_string(list_filter([{_BARE['i']}, {_BARE['n']}, {_BARE['o']}], lambda x: x <> ''), chr(10))) AS digest FROM s")
def sample_text(spark, folder):
    return samples(spark, folder).select("doc_id", F.md5(ingest.sample_text(F.col("instruction"), F.col("input"), F.col("output")).cast("binary")).alias("digest"))


_LABEL = "CASE WHEN %(f)s <> '' THEN '%(l)s: ' || %(f)s END"
_P16 = ", ".join(_LABEL % {"f": _FLAT % c, "l": n} for n, c in (("Instruction", "instruction"), ("Input", "input"), ("Output", "output")))


@register("p16_labelled_text", f"WITH {SAMPLES_SQL} SELECT doc_id, md5(concat_ws(chr(10), {_P16})) AS raw, md5(concat_ws(chr(10), {', '.join(_P16.split(', CASE')[:1])})) AS instruction FROM s")
def labelled_text(spark, folder):
    parts = F.col("instruction"), F.col("input"), F.col("output")
    return samples(spark, folder).select("doc_id", F.md5(ingest.labelled_text(*parts, "raw").cast("binary")).alias("raw"), F.md5(ingest.labelled_text(*parts, "instruction").cast("binary")).alias("instruction"))


@register("p17_prompts", f"WITH {SAMPLES_SQL} SELECT doc_id, md5({_BLOCKS % _BARE}) AS whole, md5({_BLOCKS % (_BARE | {'o': chr(39) * 2})}) AS asked FROM s")
def prompts(spark, folder):
    parts = F.col("instruction"), F.col("input")
    return samples(spark, folder).select("doc_id", F.md5(ingest.prompt(*parts, F.col("output")).cast("binary")).alias("whole"), F.md5(ingest.prompt(*parts).cast("binary")).alias("asked"))


@register("p18_gold", f"WITH {SAMPLES_SQL} SELECT doc_id, CASE WHEN {_BARE['o']} <> '' THEN {_BARE['o']} ELSE {_BARE['i']} END AS gold FROM s")
def gold(spark, folder):
    text = ingest.training_text(F.lit("x"), F.lit(None).cast("string"), F.col("instruction"))
    return samples(spark, folder).select("doc_id", ingest.gold(F.col("output"), text).alias("gold"))


@register("p19_demos", f"WITH {SAMPLES_SQL} SELECT doc_id, md5('Instruction: ' || {_BARE['i']} || chr(10) || CASE WHEN {_BARE['n']} <> '' THEN 'Input: ' || {_BARE['n']} || chr(10) ELSE '' END || 'Output: ' || output || chr(10) || chr(10)) AS demo, md5('### Query' || chr(10) || 'Instruction: ' || {_BARE['i']} || chr(10) || CASE WHEN {_BARE['n']} <> '' THEN 'Input: ' || {_BARE['n']} || chr(10) ELSE '' END || 'Output:') AS query FROM s")
def demos(spark, folder):
    parts = F.col("instruction"), F.col("input")
    return samples(spark, folder).select("doc_id", F.md5(ingest.demo(*parts, F.col("output")).cast("binary")).alias("demo"), F.md5(ingest.query_prefix(*parts).cast("binary")).alias("query"))


@register("p20_turn_pairs", "WITH t AS (SELECT conv_id, text, row_number() OVER w - 1 AS k, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, CAST(k // 2 AS INT) AS pair, text AS instruction, coalesce(next, '') AS response FROM t WHERE k % 2 = 0")
def turn_pairs(spark, folder):
    return ingest.pairs_of_turns(table(spark, folder, "conversations"))


@register("p21_ensured_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source END AS id FROM documents")
def ensured_ids(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(F.lit(" ")).alias("id"))
    return ingest.ensured_ids(rows, "id", "doc_id")


@register("p22_distinct_ids", "SELECT doc_id, CASE WHEN r = 0 THEN source ELSE source || '__' || CAST(r AS VARCHAR) END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)")
def distinct_ids(spark, folder):
    return ingest.distinct_ids(table(spark, folder, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_id")


@register("p23_judge_prompt", f"WITH {SAMPLES_SQL} SELECT doc_id, md5('Following the format <yes/no>||<explanation why yes or no>. Given the following instruction: ' || instruction || CASE WHEN input <> '' THEN ' and the following input: ' || input ELSE '' END || ', is the output ''' || output || ''' correct?') AS digest FROM s")
def judge_prompt(spark, folder):
    return samples(spark, folder).select("doc_id", F.md5(ingest.judge_prompt(F.col("instruction"), F.col("input"), F.col("output")).cast("binary")).alias("digest"))


@register("p24_capability_text", "SELECT n_nationkey, 'Capability Index: ' || CAST(n_nationkey AS VARCHAR) || chr(10) || 'Node ID: n' || CAST(n_regionkey AS VARCHAR) || chr(10) || 'Name (EN): ' || n_name || chr(10) || 'Keywords: a, b, c, d, e' AS text FROM nation")
def capability_text(spark, folder):
    words = F.array(*[F.lit(c) for c in "abcdefg"])
    return table(spark, folder, "nation").select("n_nationkey", ingest.capability_text(F.col("n_nationkey"), F.concat(F.lit("n"), F.col("n_regionkey")), F.concat(F.lit(" "), F.col("n_name")), F.lit(None).cast("string"), F.lit(" "), words).alias("text"))


@register("p25_extracted_scalar", "SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), CAST(l.toxic AS DOUBLE), n_chars / 1000.0::DOUBLE) AS scalar FROM documents d LEFT JOIN labels l USING (doc_id)")
def extracted_scalar(spark, folder):
    """The preferred field, else the fields it falls back to."""
    j = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.col("n_chars") / 1000).alias("scalar"))


@register("p26_routing_rows", "WITH r AS (SELECT vec_id, [label, -1, label + 1, label + 2] AS i FROM embeddings) SELECT vec_id, list_filter(i[1:3], lambda x: x >= 0) AS indices, list_transform(list_filter(i[1:3], lambda x: x >= 0), lambda x: 'cluster_' || CAST(x AS VARCHAR)) AS names FROM r")
def routing_rows(spark, folder):
    """Cut to three before negative indices go; nodes without a name are called after their index."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.array(F.col("label"), F.lit(-1), F.col("label") + 1, F.col("label") + 2).alias("i"))
    kept = F.filter(F.slice("i", 1, 3), lambda x: x >= 0)
    return rows.select("vec_id", kept.alias("indices"), F.transform(kept, lambda x: F.concat(F.lit("cluster_"), x.cast("string"))).alias("names"))


@register("p27_active_scores", "SELECT vec_id, list_filter(range(8), lambda i: embedding[i + 1] > 0) AS active FROM embeddings")
def active_scores(spark, folder):
    at = F.transform(F.slice("v", 1, 8), lambda x, i: F.when(x > 0, i.cast("long")))
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", F.array_compact(at).alias("active"))


@register("p28_gathered_names", "WITH n AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation) SELECT vec_id, names[label + 1] AS a, names[label + 2] AS b FROM embeddings, n")
def gathered_names(spark, folder):
    """Metadata by index: the names are one array, as many as capabilities."""
    names = table(spark, folder, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("names"))
    return table(spark, folder, "embeddings").join(F.broadcast(names)).select("vec_id", F.get("names", F.col("label")).alias("a"), F.get("names", F.col("label") + 1).alias("b"))


@register("p29_parsed_indices", "SELECT event_id, list_filter(list_transform(string_split(CAST(event_id AS VARCHAR) || ',x,-1,' || CAST(user_id AS VARCHAR), ','), lambda x: TRY_CAST(x AS INT)), lambda x: x >= 0) AS indices FROM events")
def parsed_indices(spark, folder):
    raw = F.split(F.concat_ws(",", F.col("event_id").cast("string"), F.lit("x"), F.lit("-1"), F.col("user_id").cast("string")), ",")
    return table(spark, folder, "events").select("event_id", F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda x: x >= 0).alias("indices"))


@register("p30_point_labels", "SELECT vec_id, CAST(CASE WHEN label % 3 = 0 THEN label ELSE label * 10 END AS BIGINT) AS label, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE), 6) AS score FROM embeddings")
def point_labels(spark, folder):
    """Labels from the first field that has any; a score that is a list counts by its sum."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, F.col("label")).alias("labels"), (F.col("label") * 10).alias("mig_labels"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("score"))
    return rows.select("vec_id", F.coalesce("labels", "mig_labels").cast("long").alias("label"), F.round(F.aggregate("score", F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


@register("p33_anchor_flags", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '1' ELSE '' END AS relevance, '' AS accuracy FROM documents")
def anchor_flags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "1").otherwise("").alias("relevance"), F.lit("").alias("accuracy"))


@register("p34_plain_labelled", f"WITH {SAMPLES_SQL} SELECT doc_id, CAST(length(concat_ws(chr(10), {_P16})) AS INT) AS n FROM s")
def plain_labelled(spark, folder):
    return samples(spark, folder).select("doc_id", F.length(ingest.labelled_text(F.col("instruction"), F.col("input"), F.col("output"), "raw")).alias("n"))


@register("f1_text_present", r"SELECT doc_id FROM documents WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> ''")
def text_present(spark, folder):
    return table(spark, folder, "documents").where(texts.stripped(F.col("text")) != "").select("doc_id")


@register("f2_large_categories", "SELECT coalesce(nullif(trim(lang), ''), '__MISSING_CATEGORY__') AS category, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 100")
def large_categories(spark, folder):
    return table(spark, folder, "documents").groupBy(F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("__MISSING_CATEGORY__")).alias("category")).agg(F.count("*").alias("n")).where("n > 100")


@register("f3_large_sources", "SELECT CASE WHEN source = 'src3' THEN '__MISSING_SOURCE_TYPE__' ELSE source END AS source_type, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 50")
def large_sources(spark, folder):
    named = F.coalesce(F.nullif(F.col("source"), F.lit("src3")), F.lit("__MISSING_SOURCE_TYPE__"))
    return table(spark, folder, "documents").groupBy(named.alias("source_type")).agg(F.count("*").alias("n")).where("n > 50")


@register("f4_positive_entries", "SELECT vec_id, CAST(i AS INT) AS cap, CAST(embedding[i + 1] AS DOUBLE) AS val FROM embeddings, range(64) t(i) WHERE embedding[i + 1] > 0")
def positive_entries(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("cap", "x")).where("x > 0").select("vec_id", "cap", F.col("x").cast("double").alias("val"))


@register("f5_long_responses", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND len(regexp_extract_all(text, '\\S+')) >= 4")
def long_responses(spark, folder):
    return table(spark, folder, "conversations").where("role = 'assistant'").where(F.regexp_count("text", F.lit(r"\S+")) >= 4).select("conv_id", "turn")


@register("f6_known_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def known_ids(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left_semi").select("doc_id", "n_chars")


@register("f8_cluster_scope", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= 5")
def cluster_scope(spark, folder):
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).where("n >= 5")


@register("f9_generic_names", r"SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '^\s*(economy|standard)?\s*(anodized|brushed)?')")
def generic_names(spark, folder):
    return table(spark, folder, "part").where(F.lower("p_type").rlike(r"^\s*(economy|standard)?\s*(anodized|brushed)?")).select("p_partkey")


@register("f11_gold_present", f"WITH {SAMPLES_SQL} SELECT doc_id FROM s WHERE {_BARE['o']} <> ''")
def gold_present(spark, folder):
    return samples(spark, folder).where(texts.stripped(F.col("output")) != "").select("doc_id")


@register("f12_focus_capabilities", "SELECT DISTINCT vec_id // 100 AS chunk, label FROM embeddings")
def focus_capabilities(spark, folder):
    """The capabilities that each chunk of a hundred rows has in its routing."""
    return table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("chunk"), "label").distinct()


@register("f14_cjk", "SELECT doc_id, regexp_matches(coalesce(text, ''), '[㐀-䶿一-鿿]') AS cjk FROM documents")
def cjk(spark, folder):
    return table(spark, folder, "documents").select("doc_id", texts.has_cjk(F.coalesce("text", F.lit(""))).alias("cjk"))


@register("f15_valid_leaves", "SELECT label, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY label HAVING count(DISTINCT vec_id) > 45")
def valid_leaves(spark, folder):
    return table(spark, folder, "embeddings").select("label", "vec_id").distinct().groupBy("label").agg(F.count("*").alias("n")).where("n > 45")


@register("f16_parseable_rows", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events WHERE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) IS NOT NULL AND value IS NOT NULL")
def parseable_rows(spark, folder):
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    return table(spark, folder, "events").select("event_id", k.alias("k"), "value").where("k is not null and value is not null").select("event_id", "k")
