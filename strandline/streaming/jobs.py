"""Structured Streaming over job records and events.  An addition: batch is the engine's home."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.sinks import Ledger


def read_records(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_records(records: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once, as far as its copies come within the watermark."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: list[str], size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each closed time window."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"))


def upsert_into(records: DataFrame, ledger: Ledger, name: str, key: str, checkpoint: str):
    """Insert or replace the records by key, batch by batch; replays leave the same state."""

    def put(rows: DataFrame, _: int) -> None:
        ledger.put(name, rows.dropDuplicates([key]), [key])

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
