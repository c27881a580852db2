"""Loads, upserts, exports and staging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from brightrow.columns import ref
from brightrow.operators.dedup import dedup_last
from brightrow.session import durable, free
from brightrow.sources import readers

# Write dispositions and what they mean for Spark.
DISPOSITIONS = {
    "WRITE_APPEND": "append",
    "WRITE_TRUNCATE": "overwrite",
    "WRITE_EMPTY": "errorifexists",
}


def load_table(df: DataFrame, target: str, overwrite: bool = False) -> None:
    """Append to (or replace) a catalog table, or parquet files when the target is a path."""
    writer = df.write.mode("overwrite" if overwrite else "append")
    if "/" in target:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def upsert(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str], present_only: bool = True
) -> DataFrame:
    """Base rows with updated keys replaced and new keys added; the last update per key wins."""
    last = dedup_last(updates, keys, order_by)
    if present_only:
        last = last.select(*[ref(c) for c in base.columns])
    return base.join(last.select(*[ref(k) for k in keys]), list(keys), "left_anti").unionByName(last)


def upsert_table(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str],
) -> None:
    """Upsert into a parquet table partitioned by ``partition_by``; other partitions' files stay as they are.

    Rewritten are the partitions that updates go to and those that hold a touched key now, since
    a key may move. Which ones these are is read from the keys alone. The new content is written
    aside before the table is touched, and Spark puts each partition in place as a whole.
    A partition that loses its last row goes. Keys that are null match nothing and are added.
    """
    base = spark.read.parquet(path)
    last = durable(dedup_last(updates, keys, order_by).select(*[ref(c) for c in base.columns]))
    places = [ref(c) for c in partition_by]
    held = base.join(last.select(*[ref(k) for k in keys]), list(keys), "left_semi").select(*places)
    touched = durable(held.unionByName(last.select(*places)).distinct())
    old = base.join(touched, _same(base, touched, partition_by), "left_semi")
    stay = old.join(last.select(*[ref(k) for k in keys]), list(keys), "left_anti")
    content = durable(stay.unionByName(last))
    emptied = touched.join(content.select(*places).distinct(), _same(touched, content, partition_by), "left_anti")
    # Files of partitions without rows now; as many as the table has of them.
    gone = base.join(emptied, _same(base, emptied, partition_by), "left_semi")
    files = [r[0] for r in gone.select("_metadata.file_path").distinct().collect()]
    writer = content.repartition(*places).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    for file in files:
        target = spark._jvm.org.apache.hadoop.fs.Path(file)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
    free(last, touched, content)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    """Equal in these columns, nulls included."""
    return reduce(lambda a, b: a & b, [left[f"`{c}`"].eqNullSafe(right[f"`{c}`"]) for c in columns])


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "WRITE_APPEND", batchsize: int = 1000, **properties):
    """Write to a database table; every partition uses its own connection."""
    if mode not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {mode!r}")
    options = {"url": url, "dbtable": table, "batchsize": str(batchsize), **properties}
    df.write.format("jdbc").options(**options).mode(DISPOSITIONS[mode]).save()


def copy_into(spark: SparkSession, path: str, fmt: str, table: str, schema: dict[str, str] | None = None) -> None:
    """Bulk copy of CSV (with header) or parquet files into a table."""
    kinds = {"csv": readers.read_csv, "parquet": readers.read_parquet}
    if fmt.lower() not in kinds:
        raise ValueError(f"unsupported format {fmt!r}")
    load_table(kinds[fmt.lower()](spark, path, schema), table)


def export_files(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported export format {fmt!r}")
    writer = df.write.mode(mode).format(fmt)
    # CSV with header, quotes inside values doubled.
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)


def stage(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path
