"""Readers and writers of the files that stages exchange.

JSON lines end at line feeds alone, so that other separators inside strings stay; a file with one line is one row.
Schemas are declared, never inferred. Row ids are resolved once, over alternative names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Alternative names of a row's id and of its target text, in order.
ID_FIELDS = ("id", "data_id", "uid", "idx", "index")
TARGET_FIELDS = ("output", "response", "label", "category", "answer")
SAMPLE = "id string, instruction string, input string, output string, text string, category string"
ROUTING = "id string, top_k_indices array<int>, top_k_scores array<double>, top_k_node_ids array<string>, top_k_node_names array<string>"
CAPABILITY = "order int, node_id string, capability_name string, capability_name_zh string, capability_definition string, cluster_size_tree long"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or with lines=False one JSON array or object a file."""
    reader = spark.read.schema(schema).option("lineSep", "\n") if lines else spark.read.schema(schema).option("multiLine", True)
    return reader.json(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no object of the schema fails the job."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `_bad`, which holds a line that could not be read and is null otherwise."""
    whole = f"{schema}, _bad string"
    return spark.read.schema(whole).option("lineSep", "\n").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By the ending: .parquet, .csv, .json (an array or object a file), otherwise JSON lines, folders included."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    if path.endswith(".csv"):
        return read_csv(spark, [path], schema)
    return read_json(spark, path, schema, lines=not path.endswith(".json"))


def read_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files with a header, one below the other; quoted fields may hold line feeds."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(paths)


def read_folder(spark: SparkSession, path: str, schema: str, ending: str = "*.jsonl") -> DataFrame:
    """All files below a folder, with `label`, the file's name without its ending."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", ending)
    found = rows.parquet(path) if ending.endswith("parquet") else rows.option("lineSep", "\n").json(path)
    return found.withColumn("label", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1))


def resolved_id(columns: list[str], position: str, fields: tuple[str, ...] = ID_FIELDS) -> Column:
    """The first of the id fields that a row has, as text, else its position."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields if c in columns], F.col(position).cast("string"))


def wanted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is wanted: a semi join that Spark can push into the scan as a runtime filter."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def rows_between(rows: DataFrame, position: str, start: int, most: int | None) -> DataFrame:
    low = F.col(position) >= start
    return rows.where(low if most is None else low & (F.col(position) < start + most))


def cluster_members(raw: DataFrame) -> DataFrame:
    """(cluster, sample) of a map column `m` in either orientation: keys that are samples when values start with `cluster`."""
    flat = raw.select(F.explode("m").alias("k", "vs")).select("k", F.explode("vs").alias("v"))
    turned = F.col("v").startswith("cluster")
    return flat.select(F.when(turned, F.col("v")).otherwise(F.col("k")).alias("cluster"), F.when(turned, F.col("k")).otherwise(F.col("v")).alias("sample"))


def topk_map(rows: DataFrame, position: str) -> DataFrame:
    """(id, indices): rows without indices are left out, of equal ids the last counts."""
    return rows.where(F.size("top_k_indices") > 0).groupBy("id").agg(F.max_by("top_k_indices", position).alias("indices"))


def checked_routing(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Routing rows with their text (from the row, else by id). Arrays of unequal length or a missing text are an error;
    optional arrays of another length count as absent."""
    n = F.size("top_k_indices")
    joined = rows.join(texts.select("id", F.col("text").alias("_text")), "id", "left")
    fine = F.when(F.size("top_k_scores") == n, F.col("top_k_scores")).otherwise(F.raise_error(F.concat(F.lit("indices and scores differ in length: "), "id")))
    names = F.when(F.size("top_k_node_names") == n, F.col("top_k_node_names"))
    text = F.coalesce("_text", F.raise_error(F.concat(F.lit("no text: "), "id")).cast("string"))
    return joined.select("id", "top_k_indices", fine.alias("top_k_scores"), names.alias("top_k_node_names"), text.alias("text"))


def capabilities(rows: DataFrame) -> tuple[DataFrame, int]:
    """(index, name) by order, and the number of dimensions: the largest index and one."""
    named = rows.select(F.col("order").alias("index"), F.coalesce("capability_name", "node_id").alias("name"))
    most = named.agg(F.max("index")).first()[0]
    return named, 0 if most is None else most + 1


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, c) of JSON lines, or of .npy, .pt or tree.json files, which are read in tasks from their bytes."""
    if path.endswith((".pt", ".pth")):
        return read_tensor_centroids(spark, path)
    if path.endswith("tree.json"):
        return read_tree_centroids(spark, path)
    if not path.endswith(".npy"):
        return spark.read.schema("node_id string, center_vector array<double>").option("lineSep", "\n").json(path).withColumnRenamed("center_vector", "c")

    def run(parts):
        import io

        import numpy as np
        import pandas as pd

        for part in parts:
            for data in part["content"]:
                x = np.load(io.BytesIO(data), allow_pickle=False)
                yield pd.DataFrame({"node_id": [f"row_{i}" for i in range(len(x))], "c": [r.astype(float).tolist() for r in x]})

    schema = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("c", T.ArrayType(T.DoubleType()))])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_tree_centroids(spark: SparkSession, path: str, scope: str = "leaf", least: int = 1) -> DataFrame:
    """(node_id, c) of a tree.json: nodes with a vector and at least so many samples, the leaves or with scope `all` all
    but the root. A tree is as small as its nodes; each file is read in one task."""

    def run(parts):
        import json

        import pandas as pd

        for part in parts:
            for data in part["content"]:
                top = json.loads(bytes(data))
                out, left = [], [(top.get("root", top), True)]
                while left:
                    node, root = left.pop()
                    children = node.get("children") or []
                    vector = node.get("leaf_center_vector") or node.get("center_vector") or node.get("center")
                    held = node.get("data_count", len(node.get("data_ids") or []))
                    if vector and held >= least and not (root and children) and (scope == "all" or not children):
                        out.append((str(node.get("node_id")), [float(x) for x in vector]))
                    left += [(c, False) for c in reversed(children)]
                yield pd.DataFrame(out, columns=["node_id", "c"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "node_id string, c array<double>")


def read_tensor_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, c) of a .pt file that holds a matrix, or a dictionary with `centroids` and maybe `node_ids`; this needs
    torch where the tasks run, and is an error without it."""

    def run(parts):
        import io

        import pandas as pd

        try:
            import torch
        except ImportError as e:
            raise RuntimeError("reading .pt files needs torch") from e
        for part in parts:
            for data in part["content"]:
                found = torch.load(io.BytesIO(bytes(data)), map_location="cpu", weights_only=True)
                rows = found["centroids"] if isinstance(found, dict) else found
                names = (found.get("node_ids") if isinstance(found, dict) else None) or [f"row_{i}" for i in range(len(rows))]
                yield pd.DataFrame({"node_id": [str(n) for n in names], "c": [[float(x) for x in r] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "node_id string, c array<double>")


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "errorifexists").option("lineSep", "\n").json(path)


def write_parquet(rows: DataFrame, path: str, key: str = "id") -> None:
    """Ids as text."""
    rows.withColumn(key, F.col(key).cast("string")).write.parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def not_yet_written(rows: DataFrame, spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows whose key an earlier, broken-off run has not written: what is left to do."""
    done = spark.read.schema(schema).json(path).select(key).distinct()
    return rows.join(done, key, "left_anti")
