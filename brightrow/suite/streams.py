"""Streams: the event table as landed files, read once to the end."""

import time

from pyspark.sql import functions as F

from brightrow.operators.nested import parse_messages
from brightrow.plans import cleaning
from brightrow.session import durable
from brightrow.streaming import messages
from brightrow.suite.registry import query, rounded, scratch, table


def _landed(spark, d, rows=None, files: int = 4) -> str:
    """Events as MQTT-shaped JSON message files."""
    path = scratch(spark, "landing")
    rows = table(spark, d, "events") if rows is None else rows
    payload = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    shaped = rows.select(
        F.concat(F.lit("events/"), "event_type").alias("topic"),
        F.when(F.col("event_id") % 9 == 0, "not json").otherwise(payload).alias("payload"),
        F.lit(1).alias("qos"),
        F.lit(False).alias("retain"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    shaped.repartitionByRange(files, "timestamp").write.json(path)
    return path


_EVENT = "event_id bigint, user_id bigint, event_type string, value double"


@query(
    "stream_parse_messages",
    "SELECT CASE WHEN event_id % 9 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS value,"
    " CASE WHEN event_id % 9 = 0 THEN 'not json' END AS raw FROM events",
)
def _(spark, d):
    target = scratch(spark, "parsed")
    stream = messages.landed_messages(spark, _landed(spark, d), max_files=1)

    def parse(batch):
        return parse_messages(batch, "payload", _EVENT).select("event_id", "value", "raw")

    query_ = messages.clean_batches(stream, parse, target, scratch(spark, "cp"), available_now=True)
    query_.awaitTermination(600)
    return spark.read.parquet(target).drop("batch_id")


@query("stream_dedup", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    rows = table(spark, d, "events")
    path, target = scratch(spark, "twice"), scratch(spark, "once")
    rows.unionByName(rows).repartitionByRange(4, "ts").write.parquet(path)
    stream = messages.landed_messages(spark, path, rows.schema, "parquet", 1)
    # The files may be picked up in any order, so the delay covers the whole span.
    once = messages.stream_dedup(stream, ["event_id"], "ts", "60 days")
    once.writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", scratch(spark, "cp")
    ).trigger(availableNow=True).start().awaitTermination(600)
    return spark.read.parquet(target).select("event_id", "user_id", "value")


@query(
    "stream_resample",
    "SELECT date_trunc('hour', ts) AS ts, event_type, round(avg(value), 6) AS value FROM events GROUP BY ALL",
)
def _(spark, d):
    """All windows: those still open at the end come out when a closing message moves the time on."""
    rows = table(spark, d, "events").select("ts", "event_type", "value")
    path, target, checkpoint = scratch(spark, "readings"), scratch(spark, "hourly"), scratch(spark, "cp")
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    closing = rows.agg((F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts")).select(
        "ts", F.lit("closing").alias("event_type"), F.lit(None).cast("double").alias("value")
    )
    for part in (None, closing):
        if part is not None:
            part.write.mode("append").parquet(path)
        stream = messages.landed_messages(spark, path, rows.schema, "parquet")
        hourly = messages.stream_resample(stream, "ts", ["value"], "1 hour", ["event_type"])
        hourly.writeStream.format("parquet").option("path", target).option(
            "checkpointLocation", checkpoint
        ).outputMode("append").trigger(availableNow=True).start().awaitTermination(600)
    out = spark.read.parquet(target).where("event_type <> 'closing'")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "value")


@query(
    "stream_clean_batches",
    "SELECT event_id, upper(event_type) AS event_type FROM events WHERE event_id % 9 <> 0",
)
def _(spark, d):
    target = scratch(spark, "clean")
    stream = messages.landed_messages(spark, _landed(spark, d), max_files=2)

    def tidy(batch):
        parsed = parse_messages(batch, "payload", _EVENT).where("raw IS NULL").select("event_id", "event_type")
        steps = ["distinct", "trim", "lower", "upper", "special", "empty_rows"]
        return cleaning.clean(parsed, steps).data

    query_ = messages.clean_batches(stream, tidy, target, scratch(spark, "cp"), available_now=True)
    query_.awaitTermination(600)
    return spark.read.parquet(target).drop("batch_id")


@query(
    "stream_resume",
    "SELECT topic, CAST(count(*) AS BIGINT) AS n FROM (SELECT concat('events/', event_type) AS topic FROM events) GROUP BY 1",
)
def _(spark, d):
    """Two runs on one checkpoint: the second continues where the first stopped."""
    events = table(spark, d, "events")
    landing, target, checkpoint = scratch(spark, "landing"), scratch(spark, "seen"), scratch(spark, "cp")

    def keep(batch, batch_id):
        batch.select("topic").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    for part in range(2):
        shaped = events.where(F.col("event_id") % 2 == part).select(
            F.concat(F.lit("events/"), "event_type").alias("topic"), F.col("ts").cast("timestamp").alias("timestamp")
        )
        shaped.write.mode("append").json(landing)
        stream = messages.landed_messages(spark, landing)
        messages.run_batches(stream, keep, checkpoint, available_now=True).awaitTermination(600)
    return spark.read.parquet(target).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_bounded",
    "SELECT CAST(least(count(*), 2500) AS BIGINT) AS taken FROM events",
)
def _(spark, d):
    target = scratch(spark, "taken")
    stream = messages.landed_messages(spark, _landed(spark, d), max_files=1)

    def keep(batch, batch_id):
        batch.select("topic").write.mode("overwrite").parquet(f"{target}/part={batch_id}")

    messages.drain(stream, keep, scratch(spark, "cp"), max_messages=2500)
    return spark.read.parquet(f"{target}/*").agg(F.count(F.lit(1)).alias("taken"))


@query("stream_bounded_then_rest", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    """2,500 messages, then the rest on the same checkpoint: together the table."""
    target, checkpoint = scratch(spark, "taken"), scratch(spark, "cp")
    landing = _landed(spark, d)

    def keep(batch, batch_id):
        batch.select("topic").write.mode("overwrite").parquet(f"{target}/part={batch_id}")

    for most in (2500, None):
        messages.drain(messages.landed_messages(spark, landing, max_files=1), keep, checkpoint, most)
    rows = spark.read.parquet(f"{target}/*").select(F.substring_index("topic", "/", -1).alias("event_type"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_batch_sizes",
    "SELECT CAST(count(*) AS BIGINT) AS messages, 4 AS batches FROM events",
)
def _(spark, d):
    """Every micro-batch is measured; the sizes add up to the table."""
    metrics = messages.BatchMetrics()
    stream = messages.landed_messages(spark, _landed(spark, d), max_files=1)
    keep = metrics.around(lambda batch, i: durable(batch.select("topic")))
    messages.drain(stream, keep, scratch(spark, "cp"))
    rows = [(b["messages"], 1) for b in metrics.batches]
    return spark.createDataFrame(rows, "messages long, batches int").agg(
        F.sum("messages").alias("messages"), F.sum("batches").cast("int").alias("batches")
    )


@query(
    "stream_closed_batches",
    """
    WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
    b AS (SELECT event_type, n, unnest(range(0, CAST(ceil(n / 100.0) AS BIGINT))) AS batch FROM e)
    SELECT concat('events/', event_type) AS topic, CAST(batch AS BIGINT) AS batch,
           CAST(least(100, n - 100 * batch) AS BIGINT) AS messages FROM b
    """,
)
def _(spark, d):
    """Batches of 100 messages per topic from files of many more; the last ones close by time."""
    landing, target, checkpoint = _landed(spark, d), scratch(spark, "closed"), scratch(spark, "cp")
    expected = table(spark, d, "events").count()
    stream = messages.closed_batches(messages.landed_messages(spark, landing, max_files=1), 100, 0.5, ["topic"])
    running = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    running = running.trigger(processingTime="0 seconds").start()
    try:
        deadline = time.monotonic() + 300
        while time.monotonic() < deadline and running.isActive:
            if running.lastProgress and spark.read.schema(stream.schema).parquet(target).count() >= expected:
                break
            time.sleep(0.5)
    finally:
        running.stop()
    rows = spark.read.schema(stream.schema).parquet(target)
    return rows.groupBy("topic", "batch").agg(F.count(F.lit(1)).alias("messages"))
