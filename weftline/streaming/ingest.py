"""Incremental runs: new files in a folder become rows of a table, each key once, safe to start again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Read new Parquet files of ``folder`` and write each key once.

    Keys that were seen stand in the state store of the checkpoint, partitioned by key, so no batch reads
    the target. Each batch goes to a folder named by its number and overwrites it, so a batch that is run
    again after a failure leaves no copy.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    rows = (transform(stream) if transform else stream).dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, time: str, late: str, size: str, *by: str) -> DataFrame:
    """(window, by, n, failed): results per event-time window; rows later than ``late`` are left out."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, size), *by)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed"))
