"""Following a change stream with Structured Streaming.

Applying is idempotent: rows carry their own sequences, so what is applied is appended and the newest
version is chosen on reading. A batch that is delivered again overwrites the folder it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tail(spark: SparkSession, changes: str, files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame of the change files in a folder."""
    schema = spark.read.parquet(changes).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(changes)


def follow(spark: SparkSession, changes: str, applied: str, progress: str) -> None:
    """Applies all changes that are there and have not been applied yet, then returns."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{applied}/batch={number}")

    stream = tail(spark, changes).writeStream.foreachBatch(apply).option("checkpointLocation", progress).trigger(availableNow=True).start()
    stream.awaitTermination()
