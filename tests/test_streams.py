"""Streams killed and started again, and runs of repeats against the batch operator."""

from __future__ import annotations

import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.streaming.resumable import repeats, sessions, write_once


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-streams-")


def test_a_killed_stream_writes_each_row_once(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id") % 4 <= i + 1).where(F.col("event_id") % 4 >= i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    calls = []

    def work(rows):
        calls.append(rows.count())
        if len(calls) == 2:
            rows.limit(5).write.mode("append").parquet(f"{folder}/out")  # a batch that is cut short after some rows
            raise RuntimeError("killed")
        return rows

    with pytest.raises(Exception, match="killed"):
        write_once(source, f"{folder}/out", f"{folder}/progress", ["event_id"], f"{folder}/check", work).awaitTermination()
    cut = spark.read.parquet(f"{folder}/out").count()
    write_once(source, f"{folder}/out", f"{folder}/progress", ["event_id"], f"{folder}/check", work).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert 0 < cut < out.count() == out.select("event_id").distinct().count() == events.count()
    assert out.exceptAll(events).count() == 0
    told = {r["batch"]: (r["given"], r["written"]) for r in spark.read.parquet(f"{folder}/progress").collect()}
    assert sorted(told) == [0, 1, 2] and told[0][1] + told[1][1] + 5 + told[2][1] == events.count()
    assert calls[2] == calls[1] - 5
    write_once(source, f"{folder}/out", f"{folder}/progress", ["event_id"], f"{folder}/check", work).awaitTermination()
    assert len(calls) == 4


def test_a_second_stream_over_the_same_rows_adds_nothing(spark, folder):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "id int, v string")
    rows.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    for check in ("one", "two"):
        write_once(source, f"{folder}/out", f"{folder}/{check}-progress", ["id"], f"{folder}/{check}").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == [(1, "a"), (2, "b")]
    assert spark.read.parquet(f"{folder}/two-progress").first()["written"] == 0


def test_repeats_equal_the_batch(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    end = events.agg(F.max("ts")).first()[0]
    last = spark.createDataFrame([(-1, end, -1)], "event_id long, ts timestamp, user_id long").withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    for part in (events.orderBy("ts").limit(400), events.orderBy(F.desc("ts")).limit(events.count() - 400), last):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = repeats(source, "ts", "user_id", late="1 hour").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = Counter(map(tuple, sessions(events, "ts", "user_id").collect()))
    found = Counter(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    assert found == whole
