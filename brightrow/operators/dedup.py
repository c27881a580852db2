"""Deduplication by equal keys.

Keeping the first, last, largest or smallest row per key is written as
``row_number() = 1``: Spark turns that filter into a group limit that runs
before the shuffle, so at most one row per key leaves each task, however often
a key occurs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightrow.columns import ref
from brightrow.operators.project import order_columns
from brightrow.operators.strings import lower, round_numeric, trim


def _one_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    ranked = df.withColumns(dict(zip(names, keys)))
    window = Window.partitionBy(*names).orderBy(*order)
    return ranked.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank", *names)


def _keys(df: DataFrame, subset: Iterable[str] | None) -> list[Column]:
    return [ref(c) for c in (df.columns if subset is None else subset)]


def dedup(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key, nulls equal; which one is only fixed by ``order_by``."""
    if order_by is not None and subset is not None:
        return dedup_first(df, subset, order_by)
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def dedup_first(df: DataFrame, subset: Sequence[str] | None, order_by: Sequence[str]) -> DataFrame:
    return _one_per_key(df, _keys(df, subset), order_columns(order_by))


def dedup_last(df: DataFrame, subset: Sequence[str] | None, order_by: Sequence[str]) -> DataFrame:
    return _one_per_key(df, _keys(df, subset), [ref(c).desc_nulls_first() for c in order_by])


def dedup_keep_max(df: DataFrame, value: str, subset: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    return _one_per_key(df, _keys(df, subset), [ref(value).desc_nulls_last(), *order_columns(order_by)])


def dedup_keep_min(df: DataFrame, value: str, subset: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    return _one_per_key(df, _keys(df, subset), [ref(value).asc_nulls_last(), *order_columns(order_by)])


def dedup_ignore_case(df: DataFrame, col: str, order_by: Sequence[str]) -> DataFrame:
    """The kept rows carry the lower-cased column."""
    return dedup_first(lower(df, [col]), [col], order_by)


def dedup_trimmed(df: DataFrame, col: str, order_by: Sequence[str]) -> DataFrame:
    """The kept rows carry the trimmed column."""
    return dedup_first(trim(df, [col]), [col], order_by)


def dedup_rounded(df: DataFrame, col: str, order_by: Sequence[str], decimals: int = 2) -> DataFrame:
    """The kept rows carry the rounded column."""
    return dedup_first(round_numeric(df, [col], decimals), [col], order_by)


def _combined(cols: Sequence[str]) -> Column:
    # A missing value takes part as the text "nan".
    return F.concat_ws("_", *[F.coalesce(ref(c).cast("string"), F.lit("nan")) for c in cols])


def dedup_combined(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows are equal when their values joined by ``_`` are the same text."""
    return _one_per_key(df, [_combined(cols)], order_columns(order_by))


def dedup_hash(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """As :func:`dedup_combined`, on a 256-bit digest so that long keys shuffle small."""
    return _one_per_key(df, [F.sha2(_combined(cols), 256)], order_columns(order_by))


def union_parts(parts: dict[str, DataFrame], name_col: str = "__sheet_name") -> DataFrame:
    """Stack named tables by column name; absent columns become null."""
    named = [df.withColumn(name_col, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def bag_union(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_sources(dfs: Sequence[DataFrame], subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key over several tables; the earlier table wins."""
    tagged = [df.withColumn("__source", F.lit(i)) for i, df in enumerate(dfs)]
    return dedup_first(bag_union(tagged), subset, ["__source", *order_by]).drop("__source")


def count_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key; keys with nulls count too."""
    keys = _keys(df, cols)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long")
    return groups.agg(total.alias("duplicates"))


def dedup_list(df: DataFrame, col: str) -> DataFrame:
    """Distinct list items in first-seen order."""
    return df.withColumn(col, F.array_distinct(ref(col)))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One-row report: rows before, after and removed."""
    counts = before.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("side")).unionByName(
        after.agg(F.count(F.lit(1)).alias("n"), F.lit(2).alias("side"))
    )
    out = counts.agg(
        F.max(F.when(F.col("side") == 1, F.col("n"))).alias("rows_before"),
        F.max(F.when(F.col("side") == 2, F.col("n"))).alias("rows_after"),
    )
    return out.withColumn("removed", F.col("rows_before") - F.col("rows_after"))

