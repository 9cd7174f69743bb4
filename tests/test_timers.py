"""Streams with timers: pending failures equal the batch form after shuffled arrival; heartbeats and ends from a running query."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quernel.operators import governance
from quernel.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_pending_failures_equal_the_batch(spark, sf, tmp_path, rocks):
    rows = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type").isin("error", "view"))
    rows = rows.select((F.col("user_id") % 12).alias("key"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    batch = governance.pending_successes(rows.withColumn("o", F.struct("ts", "row_id")), "key", "o", F.col("failed"), ~F.col("failed"))
    want = {(r.key, r.row_id, r.success) for r in batch.select("key", "row_id", "success").collect()}
    events = rows.collect()
    random.Random(5).shuffle(events)
    end = max(r.ts for r in events)
    late = int((end - min(r.ts for r in events)).total_seconds()) + 60
    for i in range(4):  # every file holds rows of all times; the last one moves the watermark past them
        part = events[i::4] + ([(999, 10**9, end.replace(year=end.year + 1), True)] if i == 3 else [])
        spark.createDataFrame([tuple(r) for r in part], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.pending_failures_stream(source, f"{late} seconds").writeStream.format("memory").queryName("pending_out").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    assert {tuple(r) for r in spark.table("pending_out").where("row_id < 1000000000").collect()} == want


def test_heartbeats_and_the_end(spark, tmp_path, rocks):
    frames = lambda rows: spark.createDataFrame(rows, "key string, frame_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames([("a", 1), ("a", 2), ("b", 1)])
    source = spark.readStream.schema("key string, frame_id long").parquet(str(tmp_path / "in"))
    q = stateful.heartbeats_stream(source, 4, 14).writeStream.format("memory").queryName("beats").outputMode("append").trigger(processingTime="1 second").start()
    try:
        stop = time.time() + 120
        while time.time() < stop and spark.table("beats").where("kind = 'closed'").count() < 2:
            time.sleep(1)
    finally:
        q.stop()
    for key, first in (("a", 2), ("b", 1)):
        rows = spark.table("beats").where(F.col("key") == key).orderBy("seq").collect()
        assert [r.kind for r in rows] == ["frame"] * first + ["ping"] * 3 + ["closed"]
        start = rows[0].at_ms
        assert [r.at_ms - start for r in rows[first:]] == [4000, 8000, 12000, 14000]
        # the batch form puts pings at the same places of the gap up to the end
        gap = spark.createDataFrame([(key, 0.0), (key, 14.0)], "key string, s double").select("key", F.timestamp_millis((F.lit(start) + F.col("s") * 1000).cast("long")).alias("ts"))
        pings = stateful.heartbeats(gap, "key", "ts", 4).where("kind = 'ping'").select(F.unix_millis("ts").alias("t")).collect()
        assert sorted(r.t for r in pings) == [r.at_ms for r in rows if r.kind == "ping"]
