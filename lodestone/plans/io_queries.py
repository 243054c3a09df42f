"""Queries of sources (S) and sinks (K): each writes a table in the form in question and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import routing, selection
from lodestone.plans.registry import register
from lodestone.sources import files, paged
from lodestone.sources.tables import CENTROIDS_SQL, SAMPLES_SQL, samples, scratch, table
from lodestone.sources.tables import vectors as read_vectors

_SAMPLE_SQL = f"WITH {SAMPLES_SQL} SELECT id, instruction, input, output, category FROM s"
_FIVE = "id string, instruction string, input string, output string, category string"


def _five(spark, folder):
    return samples(spark, folder).select("id", "instruction", "input", "output", "category")


@register("s1_json_lines", _SAMPLE_SQL)
def json_lines(spark, folder):
    path = scratch(spark)
    files.write_json(_five(spark, folder), path)
    return files.read_json(spark, path, _FIVE)


@register("s1b_json_array", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def json_array(spark, folder):
    """One array a file. Nations fit one."""
    path = scratch(spark)
    whole = table(spark, folder, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("value"))
    whole.coalesce(1).write.text(path)
    return files.read_json(spark, path, "name string, region int", lines=False)


@register("s2_strict_lines", _SAMPLE_SQL)
def strict_lines(spark, folder):
    path = scratch(spark)
    files.write_json(_five(spark, folder), path)
    return files.read_strict(spark, path, _FIVE)


@register("s3_lenient_lines", "SELECT count(*) FILTER (doc_id % 10 <> 3) AS good, count(*) FILTER (doc_id % 10 = 3) AS bad FROM documents")
def lenient_lines(spark, folder):
    """Broken lines are counted and left out."""
    path = scratch(spark)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category")))
    table(spark, folder, "documents").select(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{broken "), "lang")).otherwise(line).alias("value")).write.text(path)
    rows = files.read_lenient(spark, path, "id string, category string")
    return rows.select("id", "_bad").agg(F.count_if(F.col("id").isNotNull()).alias("good"), F.count_if(F.col("id").isNull()).alias("bad"))


@register("s4_any_format", _SAMPLE_SQL)
def any_format(spark, folder):
    path = f"{scratch(spark)}/x.parquet"
    files.write_parquet(_five(spark, folder), path)
    return files.read_any(spark, path, _FIVE)


@register("s5_parquet", "SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def parquet(spark, folder):
    return table(spark, folder, "documents").where("n_chars > 1000").select("doc_id", "lang")


@register("s6_parquet_folders", "SELECT lang AS subject, count(*) AS n FROM documents GROUP BY lang")
def parquet_folders(spark, folder):
    """A folder a subject: the subject is a partition column, read from the path."""
    path = scratch(spark)
    table(spark, folder, "documents").select("doc_id", F.col("lang").alias("subject")).write.partitionBy("subject").parquet(path)
    return spark.read.schema("doc_id long, subject string").parquet(path).groupBy("subject").agg(F.count("*").alias("n"))


@register("s7_csv", _SAMPLE_SQL.replace("SELECT id", "SELECT id"))
def csv(spark, folder):
    """Two files with headers, one below the other; empty fields are empty texts."""
    top = scratch(spark)
    rows = _five(spark, folder)
    for side in (0, 1):
        files.write_csv(rows.where(F.col("id").cast("long") % 2 == side), f"{top}/{side}")
    return files.read_csv(spark, [f"{top}/0", f"{top}/1"], _FIVE).fillna("")


@register("s10_centroids", f"WITH {CENTROIDS_SQL} SELECT CAST(label AS VARCHAR) AS node_id, round(c[1], 6) AS first FROM c")
def centroids(spark, folder):
    path = scratch(spark)
    c = routing.centroids(read_vectors(spark, folder), "label", "v")
    c.select(F.col("label").cast("string").alias("node_id"), F.col("c").alias("center_vector")).write.json(path)
    return files.read_centroids(spark, path).select("node_id", F.round(F.col("c")[0], 6).alias("first"))


@register("s10b_tree_centroids", f"WITH {CENTROIDS_SQL} SELECT 'leaf' || CAST(label AS VARCHAR) AS node_id, round(c[1], 6) AS first FROM c")
def tree_centroids(spark, folder):
    """The leaves of a tree that was written as one JSON document."""
    path = f"{scratch(spark)}/tree.json"
    c = routing.centroids(read_vectors(spark, folder), "label", "v")
    leaf = F.struct(F.concat(F.lit("leaf"), "label").alias("node_id"), F.col("n").alias("data_count"), F.col("c").alias("leaf_center_vector"))
    root = F.struct(F.lit("root").alias("node_id"), F.sum("n").alias("data_count"), F.collect_list(leaf).alias("children"))
    c.agg(F.to_json(root).alias("value")).coalesce(1).write.text(path)
    return files.read_tree_centroids(spark, path).select("node_id", F.round(F.col("c")[0], 6).alias("first"))


@register("s11_folder_labels", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def folder_labels(spark, folder):
    path = scratch(spark)
    table(spark, folder, "documents").select("doc_id", "lang").write.partitionBy("lang").json(path)
    rows = spark.read.schema("doc_id long").option("recursiveFileLookup", True).json(path).withColumn("label", F.regexp_extract(F.col("_metadata.file_path"), "lang=([a-z]+)", 1))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@register("s12_wanted_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def wanted_ids(spark, folder):
    return files.wanted(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels").where("quality = 1"), "doc_id")


@register("s13_row_range", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents QUALIFY position BETWEEN 100 AND 149")
def row_range(spark, folder):
    return files.rows_between(selection.positions(table(spark, folder, "documents").select("doc_id"), "doc_id"), "position", 100, 50)


@register("s15_cluster_dictionary", "SELECT 'cluster' || CAST(label AS VARCHAR) AS cluster, 's' || CAST(vec_id AS VARCHAR) AS sample FROM embeddings")
def cluster_dictionary(spark, folder):
    """Samples by cluster, or clusters by sample: both give the same rows."""
    e = table(spark, folder, "embeddings").select(F.concat(F.lit("cluster"), "label").alias("c"), F.concat(F.lit("s"), "vec_id").alias("s"), "vec_id")
    one = e.where("vec_id % 2 = 0").groupBy("c").agg(F.map_from_arrays(F.array("c"), F.array(F.collect_list("s"))).alias("m")).select("m")
    other = e.where("vec_id % 2 = 1").select(F.create_map("s", F.array("c")).alias("m"))
    return files.cluster_members(one).unionByName(files.cluster_members(other))


@register("s16_topk_map", "SELECT CAST(user_id AS VARCHAR) AS id, [CAST(max(event_id) % 7 AS INT)] AS indices FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def topk_map(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 != 0, F.array((F.col("event_id") % 7).cast("int"))).otherwise(F.array().cast("array<int>")).alias("top_k_indices"), "event_id")
    return files.topk_map(rows, "event_id")


@register("s17_text_map", f"WITH {SAMPLES_SQL} SELECT id, length(instruction) AS n FROM s WHERE instruction <> ''")
def text_map(spark, folder):
    s = samples(spark, folder)
    return s.select(files.resolved_id(s.columns, "doc_id").alias("id"), F.length("instruction").cast("long").alias("n")).where("n > 0")


@register("s18_checked_routing", "SELECT CAST(e.vec_id AS VARCHAR) AS id, [label] AS top_k_indices, [0.5::DOUBLE] AS top_k_scores, lang AS text FROM embeddings e JOIN documents ON doc_id = vec_id")
def checked_routing(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("text"))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.array("label").alias("top_k_indices"), F.array(F.lit(0.5)).alias("top_k_scores"), F.array(F.lit("a"), F.lit("b")).alias("top_k_node_names"))
    return files.checked_routing(files.wanted(rows, texts), texts).select("id", "top_k_indices", "top_k_scores", "text")


@register("s19_capabilities", "SELECT n_nationkey AS index, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'n' || CAST(n_nationkey AS VARCHAR)) AS name, CAST((SELECT max(n_nationkey) + 1 FROM nation) AS INT) AS m FROM nation")
def capabilities(spark, folder):
    path = scratch(spark)
    n = table(spark, folder, "nation")
    n.select(F.col("n_nationkey").alias("order"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("capability_name")).write.json(path)
    named, m = files.capabilities(files.read_json(spark, path, files.CAPABILITY))
    return named.withColumn("m", F.lit(m))


@register("s20_cluster_descriptors", "SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS node_id, count(*) AS cluster_size_tree FROM nation GROUP BY n_regionkey HAVING count(*) >= 5 ORDER BY node_id LIMIT 3")
def cluster_descriptors(spark, folder):
    """Clusters of a least size, the first three by id."""
    path = scratch(spark)
    table(spark, folder, "nation").groupBy(F.concat(F.lit("r"), "n_regionkey").alias("node_id")).agg(F.count("*").alias("cluster_size_tree")).write.json(path)
    return files.read_json(spark, path, files.CAPABILITY).where("cluster_size_tree >= 5").orderBy("node_id").limit(3).select("node_id", "cluster_size_tree")


@register("k1_json", "SELECT doc_id, quality FROM labels")
def json(spark, folder):
    path = scratch(spark)
    files.write_json(table(spark, folder, "labels").select("doc_id", "quality"), path)
    return files.read_strict(spark, path, "doc_id long, quality int")


@register("k2_append", "SELECT doc_id FROM labels")
def append(spark, folder):
    path = scratch(spark)
    rows = table(spark, folder, "labels").select("doc_id")
    for side in (0, 1):
        files.write_json(rows.where(F.col("doc_id") % 2 == side), path, append=True)
    return files.read_strict(spark, path, "doc_id long")


@register("k3_parquet", "SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings")
def parquet_sink(spark, folder):
    path = scratch(spark)
    files.write_parquet(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label"), path)
    return spark.read.schema("id string, label int").parquet(path)


@register("k4_csv_summary", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def csv_summary(spark, folder):
    path = scratch(spark)
    files.write_csv(table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n")), path)
    return files.read_csv(spark, [path], "lang string, n long")


@register("k5_manifest", "SELECT CAST(count(DISTINCT label) AS BIGINT) AS count, 64 AS dim FROM embeddings")
def manifest(spark, folder):
    path = scratch(spark)
    table(spark, folder, "embeddings").agg(F.count_distinct("label").alias("count"), F.max(F.size("embedding")).alias("dim")).coalesce(1).write.json(path)
    return files.read_strict(spark, path, "count long, dim int")


@register("k6_tree_tables", "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS node_id, 'r' || CAST(n_regionkey AS VARCHAR) AS parent_id FROM nation")
def tree_tables(spark, folder):
    """A tree as a table of nodes; Spark schemas are not recursive."""
    path = scratch(spark)
    table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")).write.parquet(path)
    return spark.read.schema("node_id string, parent_id string").parquet(path)


@register("k7_resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resume(spark, folder):
    path = scratch(spark)
    rows = table(spark, folder, "documents").select("doc_id")
    files.write_json(rows.where("doc_id % 3 = 0"), path)
    return files.not_yet_written(rows, spark, path, "doc_id long", "doc_id")


@register("k8_run_meta", "SELECT count(*) AS pool, CAST(100 AS INT) AS budget, CAST(42 AS INT) AS seed FROM documents")
def run_meta(spark, folder):
    path = scratch(spark)
    table(spark, folder, "documents").agg(F.count("*").alias("pool")).withColumn("budget", F.lit(100)).withColumn("seed", F.lit(42)).coalesce(1).write.json(path)
    return files.read_strict(spark, path, "pool long, budget int, seed int")


@register("k9_state", f"WITH {CENTROIDS_SQL} SELECT label AS cap, round(list_sum(c), 5) AS total FROM c")
def state(spark, folder):
    """Anchor vectors by capability, written and read as the state of a later run."""
    path = scratch(spark)
    routing.centroids(read_vectors(spark, folder), "label", "v").select(F.col("label").alias("cap"), F.col("c").alias("g")).write.parquet(path)
    return spark.read.schema("cap int, g array<double>").parquet(path).select("cap", F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@register("s8_paged_rows", "SELECT CAST(i AS BIGINT) AS id, CAST(i * i % 97 AS BIGINT) AS x FROM range(250) t(i)")
def paged_rows(spark, folder):
    """A paged service, here one that computes its rows and fails at first."""
    failed: set[int] = set()

    def fetch(offset, length):
        if offset % 3 == 0 and offset not in failed:
            failed.add(offset)
            raise TimeoutError
        return [{"id": i, "x": i * i % 97} for i in range(offset, offset + length)]

    return paged.read_pages(spark, fetch, 250, 40, "id long, x long", pause=0.01)
