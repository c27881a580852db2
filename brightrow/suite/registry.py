"""Registration of queries: name, Spark function and, where it exists, SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightrow.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# White space as a regular-expression class and as a string, for the SQL side.
SQL_SPACE = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SQL_STRIP = rf"'^[{SQL_SPACE}]+|[{SQL_SPACE}]+$'"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under a name."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can write to."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def digest(name: str) -> Column:
    """Short stand-in for a long text in a result."""
    return F.md5(F.col(name)).alias(name)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles compared between engines are rounded, since sums depend on order."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})
