"""Tables of a data folder, and a shared scratch folder for what queries write and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as instruction samples: the first line, the second, and all others; language as category, source as type."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    return table(spark, folder, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), line(0).alias("instruction"), line(1).alias("input"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("output"), F.col("lang").alias("category"), F.col("source").alias("source_type")
    )


SAMPLES_SQL = "s AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, split_part(coalesce(text, ''), chr(10), 1) AS instruction, split_part(coalesce(text, ''), chr(10), 2) AS input, array_to_string(string_split(coalesce(text, ''), chr(10))[3:], chr(10)) AS output, lang AS category, source AS source_type FROM documents)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, v: embeddings in doubles."""
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


VECTORS_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CENTROIDS_SQL = VECTORS_SQL + ", pos AS (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) t(i) GROUP BY label, i), c AS (SELECT label, list(a ORDER BY i) AS c FROM pos GROUP BY label)"
