"""Columns, predicates, order, limits, pages, joins and simple counts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightrow.columns import present, ref
from brightrow.functions import text

# The comparison operators a selection accepts.
COMPARISONS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    gone = set(cols)
    return df.select(*[ref(c) for c in df.columns if c not in gone])


def require_columns(df: DataFrame, cols: Iterable[str] | Mapping[str, str]) -> DataFrame:
    """Add absent columns as null (double unless a type is given)."""
    types = cols if isinstance(cols, Mapping) else dict.fromkeys(cols, "double")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def normalize_names(df: DataFrame) -> DataFrame:
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide once lower-cased: {sorted(names)}")
    return df.toDF(*names)


def remove_zero_rows(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Drop rows in which every chosen column is zero; null counts as not zero."""
    from brightrow.columns import choose_numbers

    names = choose_numbers(df, cols)
    if not names or (cols is None and len(names) < len(df.columns)):
        return df  # a non-numeric column never equals zero, so no row qualifies
    zero = F.lit(True)
    for c in names:
        zero = zero & F.coalesce(ref(c) == 0, F.lit(False))
    return df.where(~zero)


def remove_matching(df: DataFrame, keywords: Sequence[str], col: str = "message") -> DataFrame:
    """Drop rows whose text matches any keyword (read as patterns); null text stays."""
    if col not in df.columns or not keywords:
        return df
    return df.where(~F.coalesce(ref(col).rlike("|".join(keywords)), F.lit(False)))


def extract_fields(df: DataFrame, patterns: Mapping[str, str], col: str = "message") -> DataFrame:
    """A new column per pattern with its first capture group, null on no match."""
    if col not in df.columns:
        return df
    return df.withColumns({name: text.extract_first(ref(col), p) for name, p in patterns.items()})


def sort_by(df: DataFrame, cols: str | Sequence[str], ascending: bool = True) -> DataFrame:
    """Global order with missing values last in both directions."""
    return df.orderBy(*order_columns([cols] if isinstance(cols, str) else cols, ascending))


def order_columns(cols: Sequence[str], ascending: bool = True) -> list[Column]:
    return [ref(c).asc_nulls_last() if ascending else ref(c).desc_nulls_last() for c in cols]


def limit_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return sort_by(df, order_by).limit(n)


def page(
    df: DataFrame,
    order_by: Sequence[str],
    page: int = 1,
    page_size: int = 1000,
    after: Sequence | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Rows of one page of an order, by its number or by the last key ``after`` which it follows.

    With ``after`` (values of ``order_by`` that are not null) only a page is held at a
    time. By number, the rows are numbered over ranges of the order and filtered, so a
    deep page holds no longer prefix than a shallow one.
    """
    from brightrow.operators.ordered import numbered

    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for c, v in zip(order_by, after, strict=True):
            beyond = beyond | (equal & ((ref(c) > F.lit(v)) | ref(c).isNull()))
            equal = equal & (ref(c) == F.lit(v))
        return sort_by(df.where(beyond), order_by).limit(page_size)
    last = page * page_size
    rows, _ = numbered(df, [], order_by, "__row", rows_per_chunk)
    rows = rows.where(F.col("__row").between(last - page_size + 1, last))
    return sort_by(rows, order_by).select(*[ref(c) for c in df.columns])


def select_where(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """ANDed ``(column, operator, value)`` comparisons; values are bound, never spliced."""
    for col, op, value in conditions:
        if op not in COMPARISONS:
            raise ValueError(f"unknown comparison {op!r}")
        df = df.where(COMPARISONS[op](ref(col), F.lit(value)))
    return df


def select_basic(df: DataFrame, cols: Sequence[str] = ("*",)) -> DataFrame:
    return df.select(*[c if c == "*" else ref(c) for c in cols])


def select_order_by(df: DataFrame, cols: Sequence[str], direction: str = "ASC") -> DataFrame:
    return sort_by(df, cols, ascending=direction.upper() != "DESC")


def select_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join; the broadcast decision stays with Spark's size threshold and AQE."""
    return left.join(right, left[left_key] == right[right_key], "inner")


def group_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*[ref(c) for c in cols]).count()


def aggregate(df: DataFrame, fn: str, col: str | None = None) -> DataFrame:
    """Global COUNT, SUM or AVG as one row."""
    if fn == "count":
        return df.agg(F.count(F.lit(1) if col is None else ref(col)).alias("count"))
    if fn not in ("sum", "avg") or col is None:
        raise ValueError("aggregate is count, sum or avg; sum and avg need a column")
    return df.agg(getattr(F, fn)(ref(col)).alias(fn))
