"""Append-only logs with resume, and streams of JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Keys of the rows a log already has; a log that does not exist has none."""
    try:
        return spark.read.schema(schema).json(path).select(*keys).dropDuplicates()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).select(*keys)


def resume(todo: DataFrame, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Rows still to do: each key once, without those in the log."""
    return todo.dropDuplicates(keys).join(finished(todo.sparkSession, path, schema, keys), keys, "left_anti")


def run_and_append(todo: DataFrame, path: str, schema: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Do what is left of `todo` and append it to the log; how many rows were left."""
    left = resume(todo, path, schema, keys)
    n = left.count()
    if n:
        work(left).write.mode("append").json(path)
    return n


def follow(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def append_log(stream: DataFrame, path: str, schema: str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query that does each arriving key once: within a batch by dropping repeats, across batches and restarts by the log."""
    def batch(df: DataFrame, _: int) -> None:
        run_and_append(df, path, schema, keys, work)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by window and type, rows later than `late` left out: an extension, the same plan on a table and on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
