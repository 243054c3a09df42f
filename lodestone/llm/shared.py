"""What the operators share: cutting lineage, splits by checksum, row order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; the warehouse's parent serves where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cuts"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them again: later jobs start there, whatever executors are lost."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cut_in_buckets(frame: DataFrame, column: str) -> DataFrame:
    """The same, with the rows dealt into buckets by a column: later groups by it need no shuffle of these rows."""
    spark, name = frame.sparkSession, f"cut_{uuid.uuid4().hex}"
    frame.write.format("parquet").option("path", shared_folder(spark)).bucketBy(partitions(spark), column).saveAsTable(name)
    return spark.table(name)


def checksum(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo `modulus`; a null counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores, as one small file gives, dealt over all of them; larger
    inputs have more and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches hold few rows and bytes: long texts then need little memory at once."""
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return frame
