"""Order-dependent work when one key may hold a large share of all rows.

A window partitioned by key puts each key in one task. That is the best plan
while every key is small. Above ``rows_per_chunk`` rows in one key (or without
a key at all) the rows are range-partitioned and sorted on (key, order) instead, and
cut along this order into chunks of ``rows_per_chunk`` rows, and what a window
needs from the rows before or after its chunk is carried over in a small table
with one row per key and chunk. Chunks may be small; ranges, which are tasks, are not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from brightrow.columns import ref
from brightrow.operators.project import order_columns
from brightrow.session import durable

CHUNK = "__chunk"
# Place of a row in the order of all rows, from 0.
PLACE = "__place"
ROWS_PER_CHUNK = 2_000_000
# Rows of a range, beyond one range per shuffle partition.
ROWS_PER_RANGE = 500_000
BROADCAST_ROWS = 50_000


def key_columns(by: Sequence[str]) -> list[Column]:
    return [ref(c) for c in by]


def split_by_order(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str], rows_per_chunk: int | None = None
) -> tuple[DataFrame, int]:
    """Add ``__chunk``; also gives the number of chunks, 0 when no key needs splitting.

    With chunks, ``__place`` is added as well. Both follow from the range partition a row falls
    in and its place there, which are written out once before use: ranges are sampled, and must
    not move between jobs. Windows over chunks go by ``__place``, one order whenever it is read.
    """
    limit = rows_per_chunk or ROWS_PER_CHUNK
    largest, total = largest_key(df, by)
    if largest <= limit:
        return df.withColumn(CHUNK, F.lit(0)), 0
    ranges = range_count(df.sparkSession, total, limit)
    order = [*key_columns(by), *order_columns(order_by)]
    sorted_ranges = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = durable(
        sorted_ranges.withColumns({"__range": F.spark_partition_id(), PLACE: place_in_range()})
    )
    # One number per range enters the plan: the rows before it.
    sizes = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes)))]
    placed = placed.withColumn(PLACE, F.get(F.lit(before), F.col("__range")) + F.col(PLACE)).drop("__range")
    return placed.withColumn(CHUNK, F.floor(F.col(PLACE) / limit)), math.ceil(total / limit)


def range_count(spark: SparkSession, total: int, limit: int) -> int:
    """Ranges for chunks of ``limit`` rows: at most as many as chunks, and no more tasks than the rows are worth."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(math.ceil(total / limit), max(usual, math.ceil(total / ROWS_PER_RANGE)))


def place_in_range() -> Column:
    """0-based place of a row in its partition."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))


def largest_key(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the most frequent key and of the whole table."""
    counts = df.groupBy(*key_columns(by)).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return row["largest"] or 0, row["total"] or 0


def chunk_window(by: Sequence[str], order_by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key_columns(by), F.col(CHUNK)).orderBy(*order_columns(order_by))


def chunk_summary(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per key and chunk, only for keys that span several chunks.

    A chunk is one contiguous range, so at most its first and last key reach
    beyond it: the result has at most two rows per chunk, whatever the data.
    """
    per = df.groupBy(*key_columns(by), F.col(CHUNK)).agg(*aggs)
    spans = F.count(F.lit(1)).over(Window.partitionBy(*key_columns(by)))
    return per.withColumn("__spans", spans).where("__spans > 1").drop("__spans")


def chunk_sequence(by: Sequence[str]) -> WindowSpec:
    """Chunks of a key in order, for carrying values along :func:`chunk_summary` rows."""
    return Window.partitionBy(*key_columns(by)).orderBy(CHUNK)


def attach(
    df: DataFrame,
    carry: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    chunks: int,
    only: Column | None = None,
) -> DataFrame:
    """Join carried columns back by key and chunk; null keys match each other. ``only`` names the rows that need them.

    The carry table has at most two rows per chunk and is broadcast while that is
    few. Beyond, it is a plain join, in which a chunk bounds the rows of a join key.
    """
    right = carry.select(
        *[ref(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(CHUNK).alias("__kc"), *cols
    )
    match = F.col(CHUNK) == F.col("__kc")
    match = match if only is None else match & only
    for i, c in enumerate(by):
        match = match & ref(c).eqNullSafe(F.col(f"__k{i}"))
    if 2 * chunks <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return df.join(right, match, "left").drop("__kc", *[f"__k{i}" for i in range(len(by))])


def numbered(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    name: str,
    rows_per_chunk: int | None = None,
) -> tuple[DataFrame, int]:
    """1-based position of each row within its key, also for keys of any size."""
    parts, chunks = split_by_order(df, by, order_by, rows_per_chunk)
    if chunks and not by:
        return parts.withColumn(name, F.col(PLACE) + 1).drop(PLACE), chunks
    local = F.row_number().over(chunk_window(by, [PLACE] if chunks else order_by)).cast("long")
    if not chunks:
        return parts.withColumn(name, local), 0
    counts = chunk_summary(parts, by, F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(chunk_sequence(by).rowsBetween(Window.unboundedPreceding, -1))
    carry = counts.withColumn("__before", before)
    out = attach(parts.withColumn(name, local), carry, by, ["__before"], chunks)
    return out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before", PLACE), chunks
