"""Scaling, z-score outliers and table summaries.

Statistics come from one aggregate job that returns a single row; they enter
the plan as literals, so no join and no extra shuffle is needed to apply them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightrow.columns import choose_numbers, known_number, numeric_columns, ref


def _spread(ddof: int):
    return F.stddev_samp if ddof else F.stddev_pop


def _moments(df: DataFrame, cols: Sequence[str], ddof: int) -> dict[str, tuple[float | None, float | None]]:
    """Mean and standard deviation of several columns in one pass."""
    if not cols:
        return {}
    wanted = []
    for i, c in enumerate(cols):
        value = known_number(df, c).cast("double")
        wanted += [F.avg(value).alias(f"m{i}"), _spread(ddof)(value).alias(f"s{i}")]
    row = df.agg(*wanted).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Iterable[str] | None = None, ddof: int = 0) -> DataFrame:
    """Mean 0 and deviation 1; a constant column becomes 0 (ddof 0) or null (ddof 1)."""
    names = choose_numbers(df, cols)
    out = {}
    for c, (mean, sd) in _moments(df, names, ddof).items():
        value = known_number(df, c).cast("double")
        if mean is None or (ddof and not sd):
            out[c] = F.lit(None).cast("double")
        else:
            out[c] = (value - F.lit(mean)) / F.lit(sd or 1.0)
    return df.withColumns(out) if out else df


def minmax(df: DataFrame, cols: Iterable[str] | None = None, constant: float | None = 0.0) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes ``constant`` (0 or null)."""
    names = choose_numbers(df, cols)
    if not names:
        return df
    wanted = []
    for i, c in enumerate(names):
        value = known_number(df, c).cast("double")
        wanted += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    row = df.agg(*wanted).first()
    out = {}
    for i, c in enumerate(names):
        low, high, value = row[f"lo{i}"], row[f"hi{i}"], known_number(df, c).cast("double")
        if low is None or low == high:
            out[c] = F.when(value.isNotNull(), F.lit(constant).cast("double"))
        else:
            out[c] = (value - F.lit(low)) / F.lit(high - low)
    return df.withColumns(out)


def flag_outliers(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """``outlier_<col>``: sample z-score strictly above the threshold."""
    mean, sd = _moments(df, [col], 1)[col]
    if not sd:
        flag = F.lit(False)
    else:
        z = F.abs((known_number(df, col).cast("double") - F.lit(mean)) / F.lit(sd))
        flag = F.coalesce(z > threshold, F.lit(False))
    return df.withColumn(f"outlier_{col}", flag)


def remove_outliers(
    df: DataFrame,
    cols: Iterable[str] | None = None,
    z: float = 3.0,
    ddof: int = 0,
    inclusive: bool = True,
    strict: bool = False,
    mode: str = "sequential",
) -> DataFrame:
    """Keep rows whose z-score stays within the limit, column after column.

    ``sequential`` measures each column on the rows the earlier columns left, at
    one aggregate job per column over just the columns met so far. ``joint``
    measures all columns on the input in a single job. Rows with a missing value
    go. A constant column is skipped, or empties the table when ``strict``.
    """
    names = choose_numbers(df, cols)
    if mode == "joint":
        stats = _moments(df, names, ddof)
        for c in names:
            df = _within(df, c, *stats[c], z, inclusive, strict)
        return df
    if mode != "sequential":
        raise ValueError(f"unknown mode {mode!r}")
    for c in names:
        df = _within(df, c, *_moments(df, [c], ddof)[c], z, inclusive, strict)
    return df


def _within(df: DataFrame, col: str, mean, sd, z: float, inclusive: bool, strict: bool) -> DataFrame:
    if not sd:
        return df.where(F.lit(False)) if strict else df
    score = F.abs((known_number(df, col).cast("double") - F.lit(mean)) / F.lit(sd))
    return df.where(score <= z if inclusive else score < z)


def null_record_outliers(df: DataFrame, cols: Iterable[str] | None = None, z: float = 3.0) -> DataFrame:
    """Null the fields of a record that stand out among the record's own numbers."""
    names = choose_numbers(df, cols)
    if not names:
        return df
    values = F.filter(F.array(*[known_number(df, c).cast("double") for c in names]), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - F.col("__mean")) * (v - F.col("__mean")))
    staged = df.withColumn("__values", values)
    staged = staged.withColumn("__mean", F.when(F.size("__values") > 0, mean))
    staged = staged.withColumn("__sd", F.when(F.size("__values") > 0, F.sqrt(square / F.size("__values"))))
    far = lambda c: (F.col("__sd") > 0) & (F.abs((ref(c) - F.col("__mean")) / F.col("__sd")) > z)
    out = staged.withColumns({c: F.when(~F.coalesce(far(c), F.lit(False)), ref(c)) for c in names})
    return out.drop("__values", "__mean", "__sd")


def count_anomalies(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """One row: how many values lie strictly beyond the sample z-score threshold."""
    mean, sd = _moments(df, [col], 1)[col]
    far: Column = F.lit(False)
    if sd:
        far = F.abs((known_number(df, col).cast("double") - F.lit(mean)) / F.lit(sd)) > threshold
    return df.agg(F.lit(col).alias("column"), F.count_if(far).alias("anomalies"))


def summarize(df: DataFrame) -> DataFrame:
    """One row per numeric column: known values, mean, deviation, range and table size."""
    names = numeric_columns(df)
    wanted = []
    for i, c in enumerate(names):
        value = known_number(df, c).cast("double")
        wanted += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"m{i}"),
            F.stddev_samp(value).alias(f"s{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *wanted)
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.col(f"n{i}").alias("known"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            F.col("rows"),
            F.lit(len(df.columns)).alias("columns"),
        )
        for i, c in enumerate(names)
    ]
    return row.select(F.inline(F.array(*items)))


# The phrases of the summary sentence.
PHRASES = {
    "en": ("No results found.", "The query returned", "rows and", "columns.", "Sample columns are", "For", "the mean is"),
    "fr_FR": (
        "Aucun résultat trouvé.",
        "La requête a renvoyé",
        "lignes et",
        "colonnes.",
        "Les colonnes d'exemple sont",
        "Pour",
        "la moyenne est",
    ),
}


def summary_sentence(df: DataFrame, lang: str = "en") -> str:
    """The summary as one sentence; the figures come from a single aggregate row."""
    none, returned, rows_and, columns, samples, for_, mean_is = PHRASES.get(lang, PHRASES["en"])
    names = numeric_columns(df)
    means = [F.avg(known_number(df, c)).alias(f"m{i}") for i, c in enumerate(names)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *means).first()
    if row["n"] == 0:
        return none
    shown = ", ".join(f"{f.name} ({f.dataType.simpleString()})" for f in df.schema.fields[:5])
    out = f"{returned} {row['n']} {rows_and} {len(df.columns)} {columns} {samples}: {shown}."
    for i, c in enumerate(names):
        if row[f"m{i}"] is not None:
            out += f" {for_} '{c}', {mean_is} {row[f'm{i}']:.2f}."
    return out


# The verdicts of the trend check.
TREND_UP, TREND_DOWN, TREND_NONE = (
    "Upward trend detected.",
    "Downward trend detected.",
    "No significant trend detected.",
)


def detect_trend(
    df: DataFrame, date_col: str, value_col: str, by: Sequence[str] = (), tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Last minus first value over the row count, labelled by its sign, per group."""
    key = F.struct(ref(date_col), *[ref(c) for c in tiebreak])
    dated = F.when(ref(date_col).isNotNull(), key)
    slope = (F.max_by(ref(value_col), dated) - F.min_by(ref(value_col), dated)) / F.count(F.lit(1))
    label = F.when(F.col("slope") > 0, TREND_UP).when(F.col("slope") < 0, TREND_DOWN).otherwise(TREND_NONE)
    return df.groupBy(*[ref(c) for c in by]).agg(slope.alias("slope")).withColumn("trend", label)


def table_growth(tables: Mapping[str, DataFrame], max_rows: int) -> DataFrame:
    """Row count per table and whether it exceeds the limit."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("alert", F.col("rows") > max_rows)
