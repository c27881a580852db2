"""Partitioned table layouts and the sizes of tables and partitions.

Sizes come from the file listing (the binary source without its content), so
no data is read for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightrow.columns import ref

PARTITION = "partition_name"
OTHER = "__other__"
# Alert limits of partitions (MB) and tables (bytes).
LARGE_PARTITION_MB = 1024
LARGE_TABLE_BYTES = 1_000_000_000


def partition_by_date(
    df: DataFrame, table: str, col: str, start: date, end: date, days: int = 7, unmatched: str = "raise"
) -> DataFrame:
    """Label rows ``<table>_<start>_<end>`` by intervals of ``days`` from ``start``.

    Starts are inclusive and ends exclusive; the last interval may pass ``end``.
    """
    covered = -(-(end - start).days // days) * days
    offset = F.datediff(ref(col).cast("date"), F.lit(start))
    first = F.date_add(F.lit(start), (F.floor(offset / days) * days).cast("int"))
    stop = F.date_add(first, days)
    name = F.concat_ws("_", F.lit(table), F.date_format(first, "yyyyMMdd"), F.date_format(stop, "yyyyMMdd"))
    inside = (offset >= 0) & (offset < covered)
    return df.withColumn(PARTITION, _or_other(F.when(inside, name), unmatched))


def date_partition_names(table: str, start: date, end: date, days: int = 7) -> list[str]:
    out, at = [], start
    while at < end:
        stop = at + timedelta(days=days)
        out.append(f"{table}_{at:%Y%m%d}_{stop:%Y%m%d}")
        at = stop
    return out


def partition_by_hash(df: DataFrame, table: str, col: str, n: int = 4) -> DataFrame:
    """Label rows ``<table>_hash_<remainder>``."""
    remainder = F.pmod(F.xxhash64(ref(col)), F.lit(n)).cast("string")
    return df.withColumn(PARTITION, F.concat(F.lit(f"{table}_hash_"), remainder))


def partition_by_range(
    df: DataFrame, table: str, col: str, ranges: Sequence[Mapping], unmatched: str = "raise"
) -> DataFrame:
    """Label rows ``<table>_<start>_<end>`` by half-open ranges."""
    name = None
    for r in ranges:
        inside = (ref(col) >= F.lit(r["start"])) & (ref(col) < F.lit(r["end"]))
        name = (F if name is None else name).when(inside, f"{table}_{r['start']}_{r['end']}")
    return df.withColumn(PARTITION, _or_other(F.lit(None).cast("string") if name is None else name, unmatched))


def _or_other(name: Column, unmatched: str) -> Column:
    if unmatched == "other":
        return F.coalesce(name, F.lit(OTHER))
    if unmatched != "raise":
        raise ValueError(f"unmatched must be raise or other, not {unmatched!r}")
    return F.coalesce(name, F.raise_error(F.lit("no partition found for a row")).cast("string"))


def partition_tables(tables: Mapping[str, DataFrame], config: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Label several tables by their configuration (``table_name``, ``partition_type``, ...)."""
    out = {}
    for c in config:
        name, kind, col = c["table_name"], c["partition_type"], c["column"]
        df = tables[name]
        unmatched = c.get("unmatched", "raise")
        if kind == "date":
            out[name] = partition_by_date(
                df, name, col, c["start_date"], c["end_date"], c.get("interval_days", 7), unmatched
            )
        elif kind == "hash":
            out[name] = partition_by_hash(df, name, col, c.get("num_partitions", 4))
        elif kind == "range":
            out[name] = partition_by_range(df, name, col, c.get("ranges", []), unmatched)
        else:
            raise ValueError(f"unsupported partition type {kind!r} for table {name!r}")
    return out


def write_partitioned(df: DataFrame, path: str, mode: str = "errorifexists", col: str = PARTITION) -> None:
    """Write one folder per partition.

    The rebalance hint brings a partition's rows together, so there are few small
    files, and lets Spark split a partition that holds a large share of the rows.
    """
    df.hint("rebalance", ref(col)).write.mode(mode).partitionBy(col).parquet(path)


def partition_sizes(spark: SparkSession, path: str, col: str = PARTITION) -> DataFrame:
    """Files and bytes per partition folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.select(ref(col), "length").groupBy(ref(col))
    return sizes.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def large_partitions(
    spark: SparkSession, path: str, limit_mb: float = LARGE_PARTITION_MB, col: str = PARTITION
) -> DataFrame:
    sizes = partition_sizes(spark, path, col).withColumn("size_mb", F.col("bytes") / (1024 * 1024))
    return sizes.where(F.col("size_mb") > limit_mb)


def table_sizes(spark: SparkSession, paths: Mapping[str, str], limit_bytes: int = LARGE_TABLE_BYTES) -> DataFrame:
    """Bytes per table and whether they exceed the limit."""
    out = None
    for name, path in paths.items():
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        part = listing.select("length").agg(
            F.lit(name).alias("table"),
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("alert", F.col("bytes") > limit_bytes)
