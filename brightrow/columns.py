"""Picking columns by type and referring to them safely."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def ref(name: str) -> Column:
    """Column reference that also works for names containing dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The requested columns that exist, in the requested order; others are ignored."""
    known = set(df.columns)
    return [c for c in cols if c in known]


def choose_strings(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    strings = string_columns(df)
    return strings if cols is None else [c for c in present(df, cols) if c in set(strings)]


def choose_numbers(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    numbers = numeric_columns(df)
    return numbers if cols is None else [c for c in present(df, cols) if c in set(numbers)]


def map_columns(df: DataFrame, cols: Iterable[str], fn) -> DataFrame:
    """Apply a Column -> Column function to several columns in a single projection."""
    updates = {c: fn(ref(c)) for c in cols}
    return df.withColumns(updates) if updates else df


def known_number(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, as the missing-value rules want it."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(ref(name)), ref(name))
    return ref(name)


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is null or NaN."""
    return known_number(df, name).isNull()
