"""Streams: windowed sums with late rows left out, and insertion that survives a repeated batch."""

import datetime

from pyspark.sql import functions as F

from larkspur.session import shared_folder
from larkspur.sources.changes import VersionedTable
from larkspur.streaming.batches import insert_stream, stream_parquet, windowed


def test_windowed_stream_equals_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_folder(spark)
    events.coalesce(1).write.parquet(folder)
    query = windowed(stream_parquet(spark, folder), "ts", ["event_type"], "value", "6 hours").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = windowed(events, "ts", ["event_type"], "value", "6 hours")
    tidy = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert tidy(spark.table("sums")) == tidy(want)


def test_late_rows_are_left_out(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    folder = shared_folder(spark)
    write = lambda rows, mode: spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode(mode).parquet(folder)
    write([(at(1), "a", 1.0), (at(20), "a", 2.0)], "overwrite")
    stream = lambda: windowed(stream_parquet(spark, folder, 1), "ts", ["k"], "v", "1 hour", late="1 hour")
    state, out = shared_folder(spark), shared_folder(spark)
    go = lambda: stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    go()
    write([(at(1), "a", 100.0), (at(23), "a", 4.0)], "append")
    go()
    found = {r["start"].hour: r["total"] for r in spark.read.parquet(out).collect()}
    assert found[1] == 1.0 and found[20] == 2.0


def test_a_repeated_batch_is_inserted_once(spark):
    source, state, target = (shared_folder(spark) for _ in range(3))
    spark.range(10).write.parquet(source)
    table = VersionedTable(spark, target)
    table.create(spark.range(0))
    insert_stream(stream_parquet(spark, source), table, state).awaitTermination()
    assert table.read().count() == 10
    # The same batches again from a fresh checkpoint: their numbers are known.
    insert_stream(stream_parquet(spark, source), table, shared_folder(spark)).awaitTermination()
    assert table.read().count() == 10
