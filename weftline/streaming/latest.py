"""The latest state of each change, from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.readers import event_lines


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of JSON lines files as they come into a folder, with the file and the line that each stands in."""
    logs = spark.readStream.format("text").option("wholetext", True).load(folder)
    return event_lines(logs.select("value", F.col("_metadata.file_name").alias("change_file")))


def latest_state(events: DataFrame, key: str = "changeId") -> DataFrame:
    """(key, time, status, node) of the last event of each key, by time, file and line; no watermark: a state never closes.

    A batch over the same events gives the same with `events.latest` and the order time, change_file, ord.
    """
    last = F.max(F.struct("time", "change_file", "ord", "status", "node")).alias("l")
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "l.time", "l.status", "l.node")


def current(spark: SparkSession, folder: str, key: str = "changeId") -> DataFrame:
    """One row for each key, that of its last batch, of the folders that to_table wrote."""
    rows = spark.read.parquet(folder)
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("l")).select(key, "l.*")


def to_table(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the states that each batch changed into batch folders, so that a batch that runs twice writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
