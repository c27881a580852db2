"""Message streams.

Timestamps of a stream must be of type ``timestamp`` (with the session zone at
UTC); ``timestamp_ntz`` columns are cast before a watermark is set.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from brightrow.columns import known_number, ref

# The columns of broker messages.
KAFKA_MESSAGE = "topic string, partition int, offset long, key string, value string, timestamp timestamp"
MQTT_MESSAGE = "topic string, payload string, qos int, retain boolean, timestamp timestamp"
# A batch closes after this many messages or seconds.
BATCH_MESSAGES, BATCH_SECONDS = 100, 5


def kafka_messages(
    spark: SparkSession, options: Mapping[str, str], max_messages: int | None = BATCH_MESSAGES
) -> DataFrame:
    """Kafka topic as a stream of messages; needs the Kafka source on the class path.

    A batch closes after ``max_messages`` or with the trigger interval; null lifts the count.
    """
    reader = spark.readStream.format("kafka").options(**options)
    if max_messages is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_messages)
    return kafka_shape(reader.load())


def kafka_shape(df: DataFrame) -> DataFrame:
    """Key and value as text, in the fixed column order."""
    return df.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
    )


def landed_messages(
    spark: SparkSession, folder: str, schema: str = MQTT_MESSAGE, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """Messages that a broker bridge lands as files in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def run_batches(
    stream: DataFrame,
    fn: Callable[[DataFrame, int], None],
    checkpoint: str,
    seconds: float = BATCH_SECONDS,
    available_now: bool = False,
    metrics: BatchMetrics | None = None,
) -> StreamingQuery:
    """Call ``fn(batch, batch_id)`` per micro-batch; progress survives restarts.

    A batch may be seen again after a failure, with the same id and content, so
    ``fn`` should write by ``batch_id``. The size of a micro-batch is set at the source
    (``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``); :func:`closed_batches` closes
    batches by messages and seconds whatever the source.
    """
    fn = fn if metrics is None else metrics.around(fn)
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def drain(
    stream: DataFrame,
    fn: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_messages: int | None = None,
    timeout: int | None = None,
) -> int:
    """Process what is there now, at most ``max_messages``, and return how many were taken.

    A later call on the same checkpoint goes on where this one stopped. A batch that the
    limit cuts is not committed: how far it was taken is noted beside the checkpoint, and
    the batch comes again with the same content. Its parts have ids of their own,
    ``"<batch>.<first row>"``. After ``timeout`` seconds the query is stopped.
    """
    spark = stream.sparkSession
    noted = f"{checkpoint.rstrip('/')}/taken"
    taken: dict[int, int] = {}

    def bounded(batch: DataFrame, batch_id: int) -> None:
        before = _taken_of(spark, noted, batch_id)
        left = None if max_messages is None else max_messages - sum(taken.values())
        if left is not None and left <= 0:
            raise _Enough
        # Read once, however often it is used.
        batch = batch.persist()
        size = batch.count() - before
        if size and (before or (left is not None and size > left)):
            part = batch.orderBy(*[F.to_json(F.struct(*batch.columns))]).offset(before)
            fn(part if left is None or size <= left else part.limit(left), f"{batch_id}.{before}")
        elif size:
            fn(batch, batch_id)
        batch.unpersist()
        taken[batch_id] = size if left is None else min(size, left)
        if left is not None and size > left:
            note = spark.createDataFrame([(batch_id, before + left)], "batch long, rows long")
            note.coalesce(1).write.mode("overwrite").parquet(noted)
            raise _Enough

    query = run_batches(stream, bounded, checkpoint, available_now=True)
    try:
        if not query.awaitTermination(timeout):
            query.stop()
    except StreamingQueryException as error:
        if _Enough.__name__ not in str(error):
            raise
    return sum(taken.values())


class _Enough(Exception):
    """The limit is reached; the batch at hand must not be committed."""


def _taken_of(spark: SparkSession, noted: str, batch_id: int) -> int:
    """Rows of the batch that an earlier call took."""
    path = spark._jvm.org.apache.hadoop.fs.Path(noted)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    row = spark.read.parquet(noted).where(F.col("batch") == batch_id).first()
    return row["rows"] if row else 0


class BatchMetrics:
    """Size, seconds and messages per second of every batch that a callback was given.

    The size is counted in the batch itself, by a pass that reads no column. What a query
    reports as its input rows follows how often the callback reads the batch, and is
    nothing if it does not. A batch that comes again after a failure is measured anew.
    """

    def __init__(self):
        self._batches: dict[int | str, dict] = {}

    @property
    def batches(self) -> list[dict]:
        return list(self._batches.values())

    def around(self, fn: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """The callback for :func:`run_batches`, :func:`drain` or ``foreachBatch``, measured."""

        def measured(batch: DataFrame, batch_id: int) -> None:
            began = time.monotonic()
            messages = batch.count()
            fn(batch, batch_id)
            seconds = time.monotonic() - began
            self._batches[batch_id] = {
                "batch_id": batch_id,
                "messages": messages,
                "seconds": seconds,
                "messages_per_second": messages / seconds if seconds else None,
            }

        return measured


def closed_batches(
    stream: DataFrame, most: int = BATCH_MESSAGES, seconds: float = BATCH_SECONDS, by: Sequence[str] = (), parts: int = 1
) -> DataFrame:
    """The messages of any source in batches that close at ``most`` messages or after ``seconds``.

    Adds ``batch``, a number that counts on per series, and ``part``. A series is one value of
    the ``by`` columns and one of ``parts`` shares of its messages, each of which fills and
    closes batches of its own; more parts spread the work. The state of a series holds what
    waits for a batch to close: fewer than ``most`` messages, and the time the first one came.
    A timer closes what waits once that is ``seconds`` ago.
    """
    share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in stream.columns]), F.lit(parts)).cast("int")
    rows = stream.select(*[ref(c) for c in stream.columns], share.alias("part"))
    fields = rows.schema.fields
    output = StructType([*fields, StructField("batch", LongType())])
    waiting = StructType([StructField("batch", LongType()), StructField("since", LongType()), StructField("rows", ArrayType(StructType(fields)))])
    names = rows.columns

    def close(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, since, kept = state.get if state.exists else (0, None, [])
        now = state.getCurrentProcessingTimeMs()
        held = [tuple(row) for row in kept]
        for piece in pieces:
            held += list(piece[names].itertuples(index=False, name=None))
            while len(held) >= most:
                yield _numbered_rows(held[:most], names, batch)
                held, batch, since = held[most:], batch + 1, None
        if held and state.hasTimedOut:
            yield _numbered_rows(held, names, batch)
            held, batch, since = [], batch + 1, None
        since = (since or now) if held else None
        state.update((batch, since, held))
        if held:
            state.setTimeoutDuration(max(1, int(since + 1000 * seconds - now)))

    return rows.groupBy(*[ref(c) for c in by], "part").applyInPandasWithState(
        close, output, waiting, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def _numbered_rows(rows: list[tuple], names: Sequence[str], batch: int) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(names)).assign(batch=batch)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts_col: str, delay: str = "10 minutes", include_ts: bool = True) -> DataFrame:
    """Drop repeats that arrive within ``delay`` of each other, with bounded state.

    Equal readings at different times are kept unless ``include_ts`` is off.
    """
    timed = df.withColumn(ts_col, ref(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    subset = list(dict.fromkeys([*keys, ts_col])) if include_ts else list(keys)
    return timed.dropDuplicatesWithinWatermark(subset)


def stream_resample(
    df: DataFrame, ts_col: str, cols: Sequence[str], freq: str = "1 minute", by: Sequence[str] = (), delay: str = "10 minutes"
) -> DataFrame:
    """Mean per tumbling window; late rows beyond ``delay`` are dropped and state is bounded."""
    timed = df.withColumn(ts_col, ref(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    means = [F.avg(known_number(df, c)).alias(c) for c in cols]
    grouped = timed.groupBy(F.window(ref(ts_col), freq).alias("__w"), *[ref(c) for c in by]).agg(*means)
    return grouped.select(F.col("__w.start").alias(ts_col), *[ref(c) for c in by], *[ref(c) for c in cols])


def clean_batches(
    stream: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    seconds: float = BATCH_SECONDS,
    available_now: bool = False,
    metrics: BatchMetrics | None = None,
) -> StreamingQuery:
    """Apply a batch cleaning plan per micro-batch and write parquet under the batch id.

    The folder of a batch is overwritten when the batch is replayed, so its rows
    appear once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint, seconds, available_now, metrics)
