"""Missing values, value mapping and category encoding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brightrow.columns import choose_numbers, choose_strings, known_number, map_columns, missing, present, ref

# A literal map above this many entries is joined as a table instead, with the same result.
MAP_LITERAL_LIMIT = 500


def fill(df: DataFrame, value="", cols: Iterable[str] | None = None) -> DataFrame:
    """Fill missing values in columns of the value's own type family."""
    names = choose_strings(df, cols) if isinstance(value, str) else choose_numbers(df, cols)
    return fill_map(df, dict.fromkeys(names, value))


def fill_map(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill missing values per column; NaN counts as missing, absent columns are ignored."""
    updates = {
        c: F.coalesce(known_number(df, c), F.lit(v).cast(df.schema[c].dataType))
        for c, v in values.items()
        if c in df.columns
    }
    return df.withColumns(updates) if updates else df


def drop_null(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in any (chosen) column."""
    keep = F.lit(True)
    for c in df.columns if subset is None else present(df, subset):
        keep = keep & ~missing(df, c)
    return df.where(keep)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every value is missing."""
    known = [~missing(df, c) for c in df.columns]
    return df.where(reduce(or_, known)) if known else df


def drop_missing(df: DataFrame, axis: str = "rows", thresh: int | None = None) -> DataFrame:
    """Drop rows or columns with fewer than ``thresh`` known values (default: all)."""
    if axis == "rows":
        need = len(df.columns) if thresh is None else thresh
        return df.where(sum(((~missing(df, c)).cast("int") for c in df.columns), F.lit(0)) >= need)
    if axis != "columns":
        raise ValueError(f"axis must be rows or columns, not {axis!r}")
    known = [F.count_if(~missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *known).first()
    need = row["n"] if thresh is None else thresh
    return df.select(*[ref(c) for i, c in enumerate(df.columns) if row[f"c{i}"] >= need])


def map_values(df: DataFrame, col: str, mapping: Mapping) -> DataFrame:
    """Map listed values, leave the others unchanged."""
    if col not in df.columns or not mapping:
        return df
    kind = df.schema[col].dataType
    mapping = {k: v for k, v in mapping.items() if v is not None}
    if len(mapping) <= MAP_LITERAL_LIMIT:
        return df.withColumn(col, _choice(ref(col), mapping, kind))
    out = df.join(_pairs(df.sparkSession, mapping, kind), ref(col) == F.col("__from"), "left")
    # A null matches no row of the table: its own entry is a literal.
    unmapped = F.coalesce(ref(col), F.lit(mapping.get(None)).cast(kind))
    mapped = F.when(F.col("__from").isNotNull(), F.col("__to")).otherwise(unmapped)
    return out.withColumn(col, mapped).select(*[ref(c) for c in df.columns])


def _pairs(spark: SparkSession, mapping: Mapping, kind: T.DataType) -> DataFrame:
    """The mapping as a table, cast as its literals are; of keys alike once cast the first counts."""
    groups: dict[tuple[T.DataType, T.DataType], list] = {}
    for at, (old, new) in enumerate(mapping.items()):
        if old is not None:
            (old, old_kind), (new, new_kind) = _typed(old), _typed(new)
            groups.setdefault((old_kind, new_kind), []).append((at, old, new))
    parts = []
    for kinds, rows in groups.items():
        fields = [T.StructField(n, t) for n, t in zip(("__at", "__from", "__to"), (T.LongType(), *kinds))]
        raw = spark.createDataFrame(rows, T.StructType(fields))
        parts.append(raw.select("__at", *[F.col(n).cast(kind).alias(n) for n in ("__from", "__to")]))
    known = reduce(DataFrame.unionByName, parts).where("__from is not null")
    return known.groupBy("__from").agg(F.min_by("__to", "__at").alias("__to"))


def _typed(value) -> tuple[object, T.DataType]:
    """A value with the type of its literal."""
    if isinstance(value, int) and not isinstance(value, bool):
        if -(2**31) <= value < 2**31:
            return value, T.IntegerType()
        if -(2**63) <= value < 2**63:
            return value, T.LongType()
        value = Decimal(value)
    if isinstance(value, Decimal):
        _, digits, exponent = value.as_tuple()
        return value, T.DecimalType(max(len(digits) + max(exponent, 0), -exponent), max(-exponent, 0))
    return value, T._infer_type(value)


def _choice(c: Column, mapping: Mapping, kind: T.DataType) -> Column:
    out = None
    for old, new in mapping.items():
        if new is not None:
            hit = c.isNull() if old is None else c == F.lit(old).cast(kind)
            out = (F if out is None else out).when(hit, F.lit(new).cast(kind))
    return c if out is None else out.otherwise(c)


def replace(df: DataFrame, mapping: Mapping, col: str | None = None) -> DataFrame:
    """Replace values in one column, or in every column whose type fits the key.

    All pairs apply at once: a replaced value is not replaced again.
    """
    updates = {}
    for name in df.columns if col is None else present(df, [col]):
        kind = df.schema[name].dataType
        fit = {old: new for old, new in mapping.items() if old is None or _fits(old, kind)}
        if fit:
            updates[name] = _choice(ref(name), fit, kind)
    return df.withColumns(updates) if updates else df


def _fits(value, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    return isinstance(kind, T.StringType if isinstance(value, str) else T.NumericType)


def categories(df: DataFrame, col: str, limit: int | None = None) -> list:
    """Sorted distinct values of a column; with ``limit``, more than that many are an error."""
    found = df.select(ref(col).alias("v")).where("v is not null").distinct()
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"column {col!r} has more than {limit} categories")
    return sorted(r["v"] for r in rows)


def one_hot(
    df: DataFrame,
    cols: Iterable[str],
    values: Mapping[str, Sequence] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Boolean column per category, the first sorted category left out.

    The result has a column per category, so a ``limit`` on their number guards against
    a column that is no category; by default there is none. Streams must pass ``values``,
    since finding the categories needs a job.
    """
    names = present(df, cols)
    found = {c: sorted((values or {}).get(c) or categories(df, c, limit)) for c in names}
    flags = [
        F.coalesce(ref(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for c in names for v in found[c][1:]
    ]
    return df.select(*[ref(c) for c in df.columns if c not in names], *flags)


def hash_encode(df: DataFrame, cols: Iterable[str], buckets: int = 10000) -> DataFrame:
    return map_columns(df, present(df, cols), lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)))
