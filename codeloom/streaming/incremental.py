"""Incremental work as Structured Streaming: each batch of changed files replaces what it had before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.store import Store


def counts_by_day(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """(day, event_type, n): tumbling windows of a day; on a stream, events later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def keep_current(
    source: DataFrame, store: Store, table: str, scope: list[str], analyse: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Analyse every batch of changed files and replace the rows of their scopes in a table.

    A batch that runs again after a failure gives the same table, and reads and writes only the parts
    of the table that its scopes lie in. ``once`` takes what is there and
    ends; otherwise the source is polled every two seconds.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.replace(table, analyse(batch), scope, batch)

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def changed_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of file snapshots that are added as parquet to a folder."""
    return spark.readStream.schema(schema).parquet(folder)
