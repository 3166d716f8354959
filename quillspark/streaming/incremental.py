"""Incremental metrics and deduplication over an append-only event log, as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(stream: DataFrame) -> tuple[DataFrame, str]:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "complete"


def first_seen(stream: DataFrame) -> tuple[DataFrame, str]:
    """The first event of each user and type, updated as earlier ones arrive."""
    return stream.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")), "complete"


def hourly_counts(stream: DataFrame) -> tuple[DataFrame, str]:
    """Counts by hour and type; in update mode, a long-running query frees the state of windows a day late."""
    late = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return late.select(F.col("window.start").alias("hour"), "event_type", "n"), "complete"


def replayed(events: DataFrame, folder: str, operator: Callable[[DataFrame], tuple[DataFrame, str]]) -> DataFrame:
    """An operator's result after a table has been streamed through it from files in ``folder``.

    Each batch is written as Parquet beside the input: in complete mode the last one is the
    result, in append mode all are.  No row passes through the driver.
    """
    spark = events.sparkSession
    events.write.parquet(f"{folder}/in")
    result, mode = operator(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    batches: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out-{number}")
        batches.append(f"{folder}/out-{number}")

    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not batches:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(*(batches[-1:] if mode == "complete" else batches))
