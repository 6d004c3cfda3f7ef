"""Streams of events: windows, sessions, duplicates and keyed state.

Late data are bounded by a watermark; run_available() drives a stream over what there is, once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "events.parquet*") -> DataFrame:
    """Files of events as they come; event time needs a time zone, so it is read in the session's."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and sum of each type in windows of one width."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of events of a user with no gap as long as `gap`."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicate(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and read its result, which is written to a shared folder."""
    spark, out = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def explain_power(calls: DataFrame, reward: float = 0.1, penalty: float = 0.05) -> DataFrame:
    """Keyed state over a stream of (key, hit): each hit raises a key's power, each miss lowers it, within [0, 1]."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        power, n = state.get if state.exists else (0.5, 0)
        for batch in batches:
            for hit in batch["hit"]:
                power, n = min(max(power + (reward if hit else -penalty), 0.0), 1.0), n + 1
        state.update((power, n))
        yield pd.DataFrame({"key": [key[0]], "power": [power], "n": [n]})

    return calls.groupBy("key").applyInPandasWithState(update, "key long, power double, n long", "power double, n long", "update", GroupStateTimeout.NoTimeout)
