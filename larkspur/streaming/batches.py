"""Structured Streaming forms: micro-batch insertion into a versioned table, and windowed sums with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.changes import VersionedTable


def stream_parquet(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """New files of a folder as a stream; the schema is that of the files that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def insert_stream(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Appends each micro batch as one change; a batch that was committed before a failure is not appended again."""

    def append(batch: DataFrame, number: int) -> None:
        if table.state().get("batch", -1) < number:
            table.insert(batch, batch=number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling or sliding window; rows later than ``late`` are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys)
    made = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")
