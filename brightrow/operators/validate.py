"""Rule checks and integrity checks.

Reports are small DataFrames with one row per check. All column rules of a
table are counted in a single aggregate pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brightrow.columns import missing, present, ref
from brightrow.functions.text import java_pattern
from brightrow.operators.dedup import count_duplicates
from brightrow.session import durable

# The type families a column type can be checked against.
FAMILIES = {
    "numeric": (T.NumericType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "bool": (T.BooleanType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def check_schema(df: DataFrame, cols: Iterable[str], raise_on_error: bool = False) -> DataFrame:
    rows = [(c, "present" if c in df.columns else "missing") for c in cols]
    if raise_on_error and any(s == "missing" for _, s in rows):
        raise ValueError(f"missing columns: {[c for c, s in rows if s == 'missing']}")
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def check_types(df: DataFrame, expected: Mapping[str, str], raise_on_error: bool = False) -> DataFrame:
    """Expected type family or exact type per column against the actual type."""
    rows = []
    for col, want in expected.items():
        kind = df.schema[col].dataType if col in df.columns else None
        actual = None if kind is None else kind.simpleString()
        match = kind is not None and (isinstance(kind, FAMILIES[want]) if want in FAMILIES else actual == want)
        rows.append((col, want, actual, match))
    if raise_on_error and not all(r[3] for r in rows):
        raise TypeError(f"column types differ: {[r[:3] for r in rows if not r[3]]}")
    return df.sparkSession.createDataFrame(
        rows, "column string, expected string, actual string, matches boolean"
    )


def _report(df: DataFrame, checks: Sequence[tuple[str, str, Column]], count_name: str) -> DataFrame:
    """One row per check, counted in one pass over the table."""
    if not checks:
        schema = f"column string, rule string, {count_name} long"
        return df.sparkSession.createDataFrame([], schema)
    counts = [F.count_if(bad).alias(f"n{i}") for i, (_, _, bad) in enumerate(checks)]
    items = [
        F.struct(F.lit(col).alias("column"), F.lit(rule).alias("rule"), F.col(f"n{i}").alias(count_name))
        for i, (col, rule, _) in enumerate(checks)
    ]
    return df.agg(*counts).select(F.inline(F.array(*items)))


def check_missing(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    names = df.columns if cols is None else present(df, cols)
    checks = [(c, "missing", missing(df, c)) for c in names]
    return _report(df, checks, "missing_count").drop("rule")


def out_of_range(col: str, low=None, high=None) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | F.coalesce(ref(col) < F.lit(low), F.lit(False))
    if high is not None:
        bad = bad | F.coalesce(ref(col) > F.lit(high), F.lit(False))
    return bad


def pattern_broken(col: str, pattern: str, allow_null: bool = False) -> Column:
    """The pattern must match at the start of the text; null is a violation."""
    hit = ref(col).cast("string").rlike(f"^(?:{java_pattern(pattern)})")
    return ~F.coalesce(hit, F.lit(allow_null))


def not_allowed(col: str, allowed: Sequence) -> Column:
    """Null is a violation unless it is listed."""
    known = [v for v in allowed if v is not None]
    hit = ref(col).isin(known) if known else F.lit(False)
    return ~F.coalesce(hit, F.lit(None in allowed))


def rule_checks(df: DataFrame, rules: Mapping[str, Mapping]) -> list[tuple[str, str, Column]]:
    """One check per column: range before pattern before allowed values."""
    checks = []
    for col, rule in rules.items():
        bad = None
        if "min" in rule or "max" in rule:
            name, bad = "range", lambda: out_of_range(col, rule.get("min"), rule.get("max"))
        elif "pattern" in rule:
            name, bad = "pattern", lambda: pattern_broken(col, rule["pattern"], rule.get("allow_null", False))
        elif "allowed" in rule:
            name, bad = "allowed", lambda: not_allowed(col, rule["allowed"])
        if bad is not None:
            checks.append((col, name, bad() if col in df.columns else F.lit(False)))
    return checks


def validate(df: DataFrame, rules: Mapping[str, Mapping], raise_on_error: bool = False) -> DataFrame:
    """Violations per column rule, with pass or fail; unknown columns pass."""
    out = _report(df, rule_checks(df, rules), "invalid_count")
    out = out.withColumn("status", F.when(F.col("invalid_count") > 0, "fail").otherwise("pass"))
    if raise_on_error:
        failed = [r["column"] for r in out.where("status = 'fail'").collect()]
        if failed:
            raise ValueError(f"validation failed for {failed}")
    return out


def check_range(df: DataFrame, col: str, low=None, high=None) -> DataFrame:
    return validate(df, {col: {"min": low, "max": high}})


def check_regex(df: DataFrame, col: str, pattern: str, allow_null: bool = False) -> DataFrame:
    return validate(df, {col: {"pattern": pattern, "allow_null": allow_null}})


def check_allowed(df: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    return validate(df, {col: {"allowed": allowed}})


def violations(df: DataFrame, rules: Mapping[str, Mapping], keys: Sequence[str]) -> DataFrame:
    """The offending rows of every rule: the caller's keys, the column, rule and value."""
    tagged = [
        F.when(
            bad,
            F.struct(F.lit(col).alias("column"), F.lit(rule).alias("rule"), ref(col).cast("string").alias("value")),
        )
        for col, rule, bad in rule_checks(df, rules)
        if col in df.columns
    ]
    return df.select(*[ref(k) for k in keys], F.inline(F.filter(F.array(*tagged), lambda v: v.isNotNull())))


def missing_rows(df: DataFrame, cols: Iterable[str], keys: Sequence[str]) -> DataFrame:
    """Keys of the rows with a missing value, one row per missing cell."""
    tagged = [F.when(missing(df, c), F.lit(c)) for c in present(df, cols)]
    found = F.filter(F.array(*tagged), lambda v: v.isNotNull())
    return df.select(*[ref(k) for k in keys], F.explode(found).alias("column"))


def check_fk(df: DataFrame, col: str, reference: DataFrame, ref_col: str) -> DataFrame:
    """Values outside a reference column; null is a violation unless listed there."""
    counted = _unmatched(df, col, reference, ref_col, null_matches_null=True)
    out = counted.select(F.lit(col).alias("column"), F.col("n").alias("invalid_count"))
    return out.withColumn("status", F.when(F.col("invalid_count") > 0, "fail").otherwise("pass"))


def fk_rows(df: DataFrame, col: str, reference: DataFrame, ref_col: str) -> DataFrame:
    """The rows whose value is outside the reference column (null included)."""
    values = reference.select(ref(ref_col).alias("__ref"))
    return df.join(values, ref(col).eqNullSafe(F.col("__ref")), "left_anti")


def fk_violations(df: DataFrame, mapping: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Orphaned foreign keys per child column; null is no violation here."""
    out = None
    for col, (parent, parent_col) in mapping.items():
        part = _unmatched(df.where(ref(col).isNotNull()), col, parent, parent_col)
        part = part.select(F.lit(col).alias("column"), F.col("n").alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


def _unmatched(
    df: DataFrame, col: str, parent: DataFrame, parent_col: str, null_matches_null: bool = False
) -> DataFrame:
    # Counting per value first sends each value over the network once per task,
    # however many rows carry it, so a hot key does not weigh on the join. It is an
    # outer join with a test, since an anti join would be moved below the counting.
    values = df.groupBy(ref(col).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    known = parent.select(ref(parent_col).alias("__ref"), F.lit(True).alias("__known")).distinct()
    same = F.col("__value").eqNullSafe(F.col("__ref")) if null_matches_null else F.col("__value") == F.col("__ref")
    unknown = values.join(known, same, "left").where("__known IS NULL")
    return unknown.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n"))


def table_report(
    df: DataFrame,
    cols: Iterable[str] | None = None,
    foreign_keys: Mapping[str, tuple[DataFrame, str]] | None = None,
    unique: Sequence[str] | None = None,
) -> DataFrame:
    """Missing values, orphaned keys and duplicate rows of one table, as (check, subject, count)."""
    nulls = check_missing(df, cols).select(
        F.lit("missing").alias("check"), F.col("column").alias("subject"), F.col("missing_count").alias("count")
    )
    doubles = count_duplicates(df, unique).select(
        F.lit("duplicates").alias("check"),
        F.lit(",".join(unique or df.columns)).alias("subject"),
        F.col("duplicates").alias("count"),
    )
    out = nulls.unionByName(doubles)
    if foreign_keys:
        orphans = fk_violations(df, foreign_keys).select(
            F.lit("foreign_key").alias("check"), F.col("column").alias("subject"), F.col("violations").alias("count")
        )
        out = out.unionByName(orphans)
    return out


def schema_diff(spark: SparkSession, old: T.StructType | Mapping, new: T.StructType | Mapping) -> DataFrame:
    """Columns whose type differs between two schemas; an absent side is null."""
    before, after = _types(old), _types(new)
    rows = [
        (c, before.get(c), after.get(c))
        for c in sorted({*before, *after})
        if before.get(c) != after.get(c)
    ]
    return spark.createDataFrame(rows, "column string, old_type string, new_type string")


def _types(schema: T.StructType | Mapping) -> dict[str, str]:
    if isinstance(schema, T.StructType):
        return {f.name: f.dataType.simpleString() for f in schema.fields}
    return dict(schema)


def schema_drift(spark: SparkSession, path: str, expected: T.StructType | Mapping[str, str]) -> DataFrame:
    """Per column and deviating type: how many parquet files of a directory carry it.

    Files are listed by the binary source without reading their content; each
    task opens only the footers of its own files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    # A row per file without a column, and one per column of it; opened once.
    found = durable(files.mapInPandas(_footers, "path string, column string, type string"))
    wanted = F.lit(None).cast("string")
    for col, kind in _types(expected).items():
        wanted = F.when(F.col("column") == col, F.lit(kind)).otherwise(wanted)
    total = found.agg(F.count_if(F.col("column").isNull()).alias("n")).first()["n"]
    seen = found.where("column is not null").groupBy("column", "type").agg(F.count(F.lit(1)).alias("files"))
    changed = seen.withColumn("expected", wanted).where(~F.col("type").eqNullSafe(F.col("expected")))
    present_in = seen.groupBy("column").agg(F.sum("files").alias("files"))
    names = spark.createDataFrame(list(_types(expected).items()), "column string, expected string")
    gone = (
        names.join(present_in, "column", "left")
        .withColumn("files", F.lit(total) - F.coalesce("files", F.lit(0)))
        .where("files > 0")
        .select("column", F.lit(None).cast("string").alias("type"), "files", "expected")
    )
    return changed.unionByName(gone).select("column", "expected", F.col("type").alias("actual"), "files")


def _footers(batches):
    import pandas as pd
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_type

    for batch in batches:
        rows = []
        for path in batch["path"]:
            uri = path if "://" in path else path.replace("file:/", "file:///", 1)
            system, inner = fs.FileSystem.from_uri(uri)
            rows.append((path, None, None))
            for field in pq.read_schema(inner, filesystem=system):
                rows.append((path, field.name, from_arrow_type(field.type).simpleString()))
        yield pd.DataFrame(rows, columns=["path", "column", "type"])
