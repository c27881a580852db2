"""Batches of streams: their sizes and when they close."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brightrow.streaming import messages

SCHEMA = "n long, topic string"


def landed(spark, folder, *sizes):
    begin = 0
    for size in sizes:
        spark.range(begin, begin + size, 1, 1).selectExpr("id AS n", "'t' AS topic").write.mode("append").json(str(folder))
        begin += size
    return messages.landed_messages(spark, str(folder), SCHEMA)


@pytest.mark.parametrize("reads", [0, 1, 2])
def test_sizes_do_not_depend_on_how_often_a_batch_is_read(spark, tmp_path, reads):
    metrics = messages.BatchMetrics()

    def fn(batch, batch_id):
        for _ in range(reads):
            batch.collect()

    stream = landed(spark, tmp_path / "in", 12)
    messages.run_batches(stream, fn, str(tmp_path / "cp"), available_now=True, metrics=metrics).awaitTermination(60)
    assert [b["messages"] for b in metrics.batches] == [12]
    assert metrics.batches[0]["messages_per_second"] > 0


def test_sizes_of_cleaned_batches(spark, tmp_path):
    metrics = messages.BatchMetrics()
    stream = landed(spark, tmp_path / "in", 7, 5)

    def twice(batch):
        assert batch.count() >= 0
        return batch.where("n < 3")

    target = str(tmp_path / "out")
    messages.clean_batches(stream, twice, target, str(tmp_path / "cp"), available_now=True, metrics=metrics).awaitTermination(60)
    assert sum(b["messages"] for b in metrics.batches) == 12
    assert spark.read.parquet(target).count() == 3


def closed(spark, stream, folder, expected):
    """Runs until ``expected`` messages came out in closed batches."""
    target = str(folder / "out")
    running = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(folder / "cp"))
    running = running.trigger(processingTime="0 seconds").start()
    try:
        deadline = time.monotonic() + 120
        while time.monotonic() < deadline and running.isActive:
            if running.lastProgress and spark.read.schema(stream.schema).parquet(target).count() >= expected:
                break
            time.sleep(0.3)
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(target)


def test_batches_close_by_count_and_by_time_and_go_on_after_a_restart(spark, tmp_path):
    stream = messages.closed_batches(landed(spark, tmp_path / "in", 250), 100, 1.0)
    found = closed(spark, stream, tmp_path, 250)
    sizes = {r["batch"]: r["n"] for r in found.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 100, 1: 100, 2: 50}
    spark.range(250, 400, 1, 1).selectExpr("id AS n", "'t' AS topic").write.mode("append").json(str(tmp_path / "in"))
    again = closed(spark, messages.closed_batches(landed(spark, tmp_path / "in"), 100, 1.0), tmp_path, 400)
    rows = again.collect()
    assert sorted(r["n"] for r in rows) == list(range(400))
    assert Counter(r["batch"] for r in rows) == {0: 100, 1: 100, 2: 50, 3: 100, 4: 50}
