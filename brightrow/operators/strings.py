"""String, date and number cleaning over chosen columns.

Without a column list, string operators work on every string column and
leave other types alone; nulls stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightrow.columns import choose_numbers, choose_strings, map_columns, present, ref, string_columns
from brightrow.functions import text
from brightrow.functions.dates import parse_timestamp


def trim(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return map_columns(df, choose_strings(df, cols), text.strip)


def lower(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return map_columns(df, choose_strings(df, cols), F.lower)


def upper(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return map_columns(df, choose_strings(df, cols), F.upper)


def upper_column(df: DataFrame, col: str = "status") -> DataFrame:
    """Upper-case one marker column when the table has it."""
    return upper(df, [col])


def squeeze(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return map_columns(df, choose_strings(df, cols), text.squeeze)


def strip_special(df: DataFrame, cols: Iterable[str] | None = None, pattern: str = text.SPECIAL) -> DataFrame:
    return map_columns(df, choose_strings(df, cols), lambda c: text.strip_special(c, pattern))


def regex_replace(df: DataFrame, patterns: Mapping[str, str], replacement: str = "") -> DataFrame:
    known = set(choose_strings(df, patterns))
    return df.withColumns(
        {
            c: F.regexp_replace(ref(c), text.java_pattern(p), replacement)
            for c, p in patterns.items()
            if c in known
        }
    )


def fix_encoding(df: DataFrame, cols: Iterable[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    return map_columns(df, choose_strings(df, cols), lambda c: text.reencode(c, encoding))


def strip_affixes(df: DataFrame, cols: Iterable[str], prefix: str = "", suffix: str = "") -> DataFrame:
    return map_columns(df, choose_strings(df, cols), lambda c: text.strip_affixes(c, prefix, suffix))


def to_text(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return map_columns(df, present(df, cols), lambda c: c.cast("string"))


def normalize_duration(df: DataFrame, col: str = "duration") -> DataFrame:
    if col not in df.columns or not isinstance(df.schema[col].dataType, T.StringType):
        return df
    return df.withColumn(col, text.duration_seconds(ref(col)))


def normalize_resolution(df: DataFrame, col: str = "resolution") -> DataFrame:
    return map_columns(df, present(df, [col]), text.resolution_text)


def to_numbers(df: DataFrame, cols: Iterable[str] = ("width", "height")) -> DataFrame:
    """Text columns to double, value by value; unreadable text becomes null."""
    return map_columns(df, choose_strings(df, cols), text.to_number)


def parse_dates(df: DataFrame, cols: Iterable[str], fmt: str | None = None) -> DataFrame:
    return map_columns(df, choose_strings(df, cols), lambda c: parse_timestamp(c, fmt))


def date_parts(df: DataFrame, col: str) -> DataFrame:
    if col not in df.columns:
        return df
    return df.withColumns(
        {
            f"{col}_year": F.year(ref(col)),
            f"{col}_month": F.month(ref(col)),
            f"{col}_day": F.dayofmonth(ref(col)),
        }
    )


def auto_cast(df: DataFrame, cols: Iterable[str] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """Cast string columns whose every non-empty value reads as a number.

    The decision is all or nothing per column and takes one aggregate over all
    columns. Pass ``types`` (from :func:`numeric_types`) to decide without a job.
    """
    names = choose_strings(df, cols)
    if not names:
        return df
    types = numeric_types(df, names) if types is None else types
    # An empty text casts to null.
    return df.withColumns({c: text.strip(ref(c)).try_cast(types[c]) for c in names if c in types})


def numeric_types(df: DataFrame, cols: Iterable[str] | None = None) -> dict[str, str]:
    """Which string columns hold only numbers, and as which type."""
    names = choose_strings(df, cols)
    if not names:
        return {}
    # Per value: 0 empty, 1 whole number of 64 bits, 2 longer whole number, 3 other number,
    # 4 no number. The largest decides.
    values = df.select(*[text.strip(ref(c)).alias(f"v{i}") for i, c in enumerate(names)])
    kinds = [
        F.max(
            F.when(F.col(f"v{i}") == "", 0)
            .when(F.col(f"v{i}").rlike(text.WHOLE_NUMBER), F.when(F.col(f"v{i}").try_cast("bigint").isNotNull(), 1).otherwise(2))
            .when(F.col(f"v{i}").rlike(text.NUMBER), 3)
            .when(F.col(f"v{i}").isNotNull(), 4)
        ).alias(f"k{i}")
        for i in range(len(names))
    ]
    row = values.agg(*kinds).first()
    found = {1: "bigint", 2: "decimal(38,0)", 3: "double"}
    return {c: found[row[f"k{i}"]] for i, c in enumerate(names) if row[f"k{i}"] in found}


def convert(df: DataFrame, types: Mapping[str, str], errors: str = "raise") -> DataFrame:
    """Cast columns; ``errors="null"`` turns an impossible value into null."""
    how = (lambda c, t: c.try_cast(t)) if errors == "null" else (lambda c, t: c.cast(t))
    return df.withColumns({c: how(ref(c), t) for c, t in types.items() if c in df.columns})


def round_numeric(df: DataFrame, cols: Iterable[str] | None = None, decimals: int = 2) -> DataFrame:
    return map_columns(df, choose_numbers(df, cols), lambda c: F.bround(c, decimals))


def scale(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    known = choose_numbers(df, factors)
    return df.withColumns({c: ref(c) * F.lit(factors[c]) for c in known})


def apply_fn(
    df: DataFrame, col: str, fn: Callable, return_type: str | None = None, skip_null: bool = False
) -> DataFrame:
    """Apply a custom function to one column.

    ``fn`` is a Column -> Column expression; give ``return_type`` when it is a
    pandas Series -> Series function instead, which then runs in Arrow batches.
    """
    if col not in df.columns:
        return df
    out: Column = fn(ref(col)) if return_type is None else F.pandas_udf(fn, return_type)(ref(col))
    return df.withColumn(col, F.when(ref(col).isNotNull(), out) if skip_null else out)


def apply_numeric(df: DataFrame, fns: Mapping[str, Callable]) -> DataFrame:
    """Null-safe custom Column functions on numeric columns."""
    known = choose_numbers(df, fns)
    return df.withColumns({c: F.when(ref(c).isNotNull(), fns[c](ref(c))) for c in known})


def strip_html(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    from brightrow.operators.html import visible_text

    names = string_columns(df) if cols is None else cols
    return map_columns(df, choose_strings(df, names), visible_text)
