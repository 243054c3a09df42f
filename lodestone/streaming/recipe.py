"""Structured Streaming entries: windowed counts with late data, running capability counts, and the recipe loop."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.scoring import AlphaState, method_signal


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) for tumbling windows. The watermark lets rows that are later go in `append` and
    `update` mode; in `complete` mode, which keeps all windows, all rows count."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def running_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Counts a key over the whole stream: state is a number a key."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def run_recipe(batches: DataFrame, state: AlphaState, checkpoint: str, seen: Callable[[int, list[float]], None]) -> AlphaState:
    """Carry method weights over micro-batches of (u: array, reward): each batch updates them once.

    The state after each batch is written beside the checkpoint, under the batch's number, before the batch counts as
    done: a query that starts again goes on from it, and a batch that is replayed does not count twice.
    """
    spark, folder = batches.sparkSession, f"{checkpoint}_states"
    fields = ["alpha", "utility", "reward_mean", "reward_var"]

    def last() -> tuple[int, dict] | None:
        try:
            row = spark.read.schema("number long, state string").json(folder).agg(F.max(F.struct("number", "state")).alias("m")).first()["m"]
        except AnalysisException:  # nothing has been written yet
            return None
        return (row["number"], json.loads(row["state"])) if row else None

    def resume() -> int:
        found = last()
        for name in fields if found else ():
            setattr(state, name, found[1][name])
        return found[0] if found else -1

    def step(batch: DataFrame, number: int) -> None:
        if number <= resume() or batch.isEmpty():
            return
        weights = state.update(*method_signal(batch))
        written = json.dumps({name: getattr(state, name) for name in fields})
        spark.createDataFrame([(number, written)], "number long, state string").coalesce(1).write.mode("append").json(folder)
        seen(number, weights)

    resume()
    query = batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state


def finished(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run the stream over what there is now and return its result, from files that its tasks write.

    In `complete` mode each batch replaces the result, in `append` mode its rows are added; a replayed batch replaces
    what it wrote before.
    """
    spark, out = stream.sparkSession, f"{checkpoint}_result"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out)
    return found.select(*stream.columns)
