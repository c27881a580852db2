"""Declarative cleaning plans.

A plan is an ordered list of step names. A step is a function of the table and
the caller's options. Their order matters: outliers, for instance, are only met
once text has become numbers. Optional steps run
when their option is given.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from brightrow.columns import numeric_columns, ref
from brightrow.functions.text import SPECIAL, SPECIAL_KEEP_COLON
from brightrow.operators import dedup, nested, nulls, project, scaling, strings, validate, windows
from brightrow.operators.anchors import dedup_time_window, dedup_tolerance
from brightrow.operators.similarity import dedup_cosine, dedup_fuzzy
from brightrow.operators.timeseries import resample_mean
from brightrow.session import durable

Step = Callable[[DataFrame, Mapping], DataFrame]


@dataclass
class Cleaned:
    data: DataFrame
    steps: list[str] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    validation: DataFrame | None = None


def _resample(df: DataFrame, o: Mapping) -> DataFrame:
    # The means are few next to the readings, and each later step looks at them anew.
    return durable(resample_mean(df, o["ts_col"], o.get("freq", "1min"), by=o.get("by", ())))


def _interpolate(df: DataFrame, o: Mapping) -> DataFrame:
    return windows.interpolate(df, None, [o["ts_col"]], o.get("by", ()))


def _distinct_rows(df: DataFrame, o: Mapping) -> DataFrame:
    """Equal rows once; on a stream batch the time column may be left out of the comparison."""
    subset = o.get("subset")
    if subset is None and o.get("ts_col") and not o.get("include_ts", True):
        subset = [c for c in df.columns if c != o["ts_col"]]
    if subset and o.get("order_by"):
        return dedup.dedup_first(df, subset, o["order_by"])
    return dedup.dedup(df, subset)


def _outliers(df: DataFrame, o: Mapping) -> DataFrame:
    skip = {o.get("ts_col"), *o.get("by", ()), *o.get("keys", ())}
    names = [c for c in numeric_columns(df) if c not in skip]
    if not names:
        return df
    # One job per column reads this table: write it once instead of redoing the steps above.
    base = durable(df) if len(names) > 1 else df
    return scaling.remove_outliers(
        base, names, o.get("z", 3.0), strict=o.get("strict", False), mode=o.get("outlier_mode", "sequential")
    )


def _smooth(df: DataFrame, o: Mapping) -> DataFrame:
    order = o.get("order_by") or ([o["ts_col"]] if o.get("ts_col") else None)
    if order is None:
        return df
    keep = {*o.get("by", ()), *o.get("keys", ()), *order}
    return windows.smooth(
        df, [c for c in numeric_columns(df) if c not in keep], order, o.get("smooth_window", 3), o.get("by", ())
    )


def _limit(df: DataFrame, o: Mapping) -> DataFrame:
    order = o.get("order_by") or ([o["ts_col"]] if o.get("ts_col") else df.columns[:1])
    return project.limit_rows(df, o["max_rows"], order)


def _auto_cast(df: DataFrame, o: Mapping) -> DataFrame:
    return strings.auto_cast(df, types=o.get("numeric_types"))


STEPS: dict[str, Step] = {
    "flatten": lambda df, o: nested.flatten(df, o.get("sep", "_")),
    "trim": lambda df, o: strings.trim(df),
    "lower": lambda df, o: strings.lower(df),
    "upper": lambda df, o: strings.upper(df),
    "squeeze": lambda df, o: strings.squeeze(df),
    "special": lambda df, o: strings.strip_special(df, pattern=o.get("special", SPECIAL)),
    "special_keep_colon": lambda df, o: strings.strip_special(df, pattern=SPECIAL_KEEP_COLON),
    "html": lambda df, o: strings.strip_html(df),
    "fill": lambda df, o: nulls.fill(df, o.get("fill_value", "")),
    "fill_zero": lambda df, o: nulls.fill(df, 0),
    "ffill": lambda df, o: windows.ffill(df, None, o["order_by"], o.get("by", ())),
    "empty_rows": lambda df, o: nulls.drop_empty_rows(df),
    "auto_cast": _auto_cast,
    "dates": lambda df, o: strings.parse_dates(df, o["date_columns"], o.get("date_format")),
    "timestamp": lambda df, o: strings.parse_dates(df, [o.get("timestamp_column", "timestamp")], o.get("date_format")),
    "distinct": _distinct_rows,
    "outliers": _outliers,
    "record_outliers": lambda df, o: scaling.null_record_outliers(
        df, [c for c in numeric_columns(df) if c not in set(o.get("keys", ()))], o.get("z", 3.0)
    ),
    "status": lambda df, o: strings.upper_column(df, "status"),
    "level": lambda df, o: strings.upper_column(df, "level"),
    "one_hot": lambda df, o: nulls.one_hot(df, o["categorical_columns"], o.get("categories")),
    "hash_encode": lambda df, o: nulls.hash_encode(df, o["categorical_columns"]),
    "regex": lambda df, o: strings.regex_replace(df, o["regex_map"]),
    "replace": lambda df, o: nulls.replace(df, o["replace_map"]),
    "mapping": lambda df, o: _mappings(df, o["mappings"]),
    "rename": lambda df, o: project.rename(df, o["rename_map"]),
    "names": lambda df, o: project.normalize_names(df),
    "minmax": lambda df, o: scaling.minmax(df, o.get("scale_columns")),
    "standard": lambda df, o: scaling.standardize(df, o.get("scale_columns")),
    "scale": lambda df, o: strings.scale(df, o["scale_map"]),
    "numeric_fns": lambda df, o: strings.apply_numeric(df, o["numeric_fns"]),
    "required": lambda df, o: project.require_columns(df, o["required_columns"]),
    "types": lambda df, o: strings.convert(df, o["type_map"], errors="null"),
    "irrelevant": lambda df, o: project.remove_matching(df, o["remove_keywords"]),
    "fields": lambda df, o: project.extract_fields(df, o["regex_fields"]),
    "resample": _resample,
    "interpolate": _interpolate,
    "smooth": _smooth,
    "sort": lambda df, o: project.sort_by(df, o["ts_col"]) if o.get("ts_col") else df,
    "limit": _limit,
    "dimensions": lambda df, o: strings.to_numbers(df),
    "resolution": lambda df, o: strings.normalize_resolution(df),
    "duration": lambda df, o: strings.normalize_duration(df),
    "list_distinct": lambda df, o: _distinct_lists(df),
}


def _mappings(df: DataFrame, mappings: Mapping[str, Mapping]) -> DataFrame:
    for col, mapping in mappings.items():
        df = nulls.map_values(df, col, mapping)
    return df


def _distinct_lists(df: DataFrame) -> DataFrame:
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            df = dedup.dedup_list(df, f.name)
    return df


# A step with "?option" runs only when that option is given.
_RECORDS = [
    "fill", "trim", "lower", "special", "auto_cast", "distinct", "outliers", "status",
    "dates?date_columns", "one_hot?categorical_columns", "regex?regex_map", "replace?replace_map",
    "rename?rename_map",
]
_STREAM = [
    "resample?ts_col", "interpolate?ts_col", "distinct", "outliers", "auto_cast", "trim", "lower", "upper",
    "special", "regex?regex_map", "one_hot?categorical_columns", "scale?scale_map",
    "numeric_fns?numeric_fns", "required?required_columns", "smooth", "sort", "empty_rows", "limit?max_rows",
]
_COLUMNAR = [
    "trim", "lower", "special", "fill", "auto_cast", "distinct", "outliers", "status", "dates?date_columns",
    "one_hot?categorical_columns", "regex?regex_map", "replace?replace_map", "rename?rename_map",
]
PLANS: dict[str, list[str]] = {
    "csv": [
        "trim", "lower", "squeeze", "special", "fill", "empty_rows", "dates?date_columns", "auto_cast",
        "distinct?subset", "mapping?mappings", "regex?regex_map", "rename?rename_map", "outliers", "status",
    ],
    "json": ["flatten", *_RECORDS],
    "xml": _RECORDS,
    "pdf": _RECORDS,
    "avro": _RECORDS,
    "sheet": _RECORDS,
    "html": ["fill", "html", *_RECORDS[1:]],
    "parquet": [*_COLUMNAR, "minmax?minmax", "standard?standard"],
    "orc": [*_COLUMNAR, "minmax?minmax", "standard?standard"],
    "workbook": ["ffill", "trim", "lower", "distinct", "names"],
    "log": [
        "fill", "trim", "lower", "special", "auto_cast", "distinct", "level", "timestamp",
        "irrelevant?remove_keywords", "fields?regex_fields", "replace?replace_map",
        "one_hot?categorical_columns",
    ],
    "sensor": [
        "resample?ts_col", "interpolate?ts_col", "distinct", "outliers", "auto_cast", "smooth", "trim",
        "lower", "special", "replace?replace_map", "one_hot?categorical_columns", "sort",
    ],
    "kafka": _STREAM,
    "mqtt": _STREAM,
    "yaml": [
        "fill", "trim", "lower", "upper", "special", "auto_cast", "dates?date_columns", "list_distinct",
        "status", "regex?regex_map", "rename?rename_map", "record_outliers", "scale?scale_map",
        "hash_encode?categorical_columns", "numeric_fns?numeric_fns", "required?required_columns",
        "types?type_map",
    ],
    "image": [
        "empty_rows", "fill?fill_value", "distinct", "auto_cast", "trim", "lower", "upper", "special",
        "dimensions", "timestamp", "regex?regex_map", "one_hot?categorical_columns", "outliers", "smooth",
        "required?required_columns", "limit?max_rows",
    ],
    "audio": [
        "empty_rows", "fill?fill_value", "distinct", "auto_cast", "trim", "lower", "upper", "special",
        "duration", "regex?regex_map", "outliers", "scale?scale_map", "smooth", "required?required_columns",
        "empty_rows", "limit?max_rows",
    ],
    "video": [
        "empty_rows", "fill?fill_value", "distinct", "auto_cast", "trim", "lower", "upper",
        "special_keep_colon", "resolution", "duration", "regex?regex_map", "outliers", "scale?scale_map",
        "smooth", "required?required_columns", "empty_rows", "limit?max_rows",
    ],
    "core": ["trim", "lower", "squeeze", "special", "fill_zero"],
}


def run_steps(df: DataFrame, steps: Sequence[str], options: Mapping) -> Cleaned:
    done = []
    for step in steps:
        name, _, option = step.partition("?")
        if not option or options.get(option) not in (None, False):
            df = STEPS[name](df, options)
            done.append(name)
    return Cleaned(df, done)


def clean(df: DataFrame, plan: str | Sequence[str], **options) -> Cleaned:
    """Run a named plan, or a list of step names, over a table."""
    return run_steps(df, PLANS[plan] if isinstance(plan, str) else plan, options)


def clean_sheets(sheets: Mapping[str, DataFrame], plan: str = "sheet", options: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
    """Clean named sheets, each with its own options."""
    return {name: clean(df, plan, **(options or {}).get(name, {})).data for name, df in sheets.items()}


# Deduplication strategies by name, as (table, columns, order) functions.
STRATEGIES: dict[str, Callable[[DataFrame, Sequence[str] | None, Sequence[str] | None, Mapping], DataFrame]] = {
    "exact": lambda df, c, o, k: dedup.dedup(df, c, o),
    "first": lambda df, c, o, k: dedup.dedup_first(df, c, o),
    "last": lambda df, c, o, k: dedup.dedup_last(df, c, o),
    "ignore_case": lambda df, c, o, k: dedup.dedup_ignore_case(df, c[0], o),
    "trimmed": lambda df, c, o, k: dedup.dedup_trimmed(df, c[0], o),
    "combined": lambda df, c, o, k: dedup.dedup_combined(df, c, o),
    "hash": lambda df, c, o, k: dedup.dedup_hash(df, c, o),
    "rounded": lambda df, c, o, k: dedup.dedup_rounded(df, c[0], o, k.get("decimals", 2)),
    "keep_max": lambda df, c, o, k: dedup.dedup_keep_max(df, k["value"], c, o or ()),
    "keep_min": lambda df, c, o, k: dedup.dedup_keep_min(df, k["value"], c, o or ()),
    "time_window": lambda df, c, o, k: dedup_time_window(df, k["ts_col"], o, k.get("seconds", 60), c),
    "tolerance": lambda df, c, o, k: dedup_tolerance(df, c[0], o, k.get("tol", 0.001)),
    "fuzzy": lambda df, c, o, k: dedup_fuzzy(df, c[0], o, k.get("threshold", 0.8)),
    "cosine": lambda df, c, o, k: dedup_cosine(df, c[0], o, k.get("threshold", 0.85)),
}


def clean_table(
    df: DataFrame,
    fmt: str,
    rules: Mapping[str, Mapping] | None = None,
    strategy: str | None = "exact",
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    strategy_options: Mapping | None = None,
    core: Sequence[str] | None = None,
    **options,
) -> Cleaned:
    """Format plan, core steps, rule checks and deduplication; a failing stage is reported.

    A failure of the format plan ends the run; later stages fail on their own.
    """
    out = Cleaned(df)
    try:
        first = clean(df, fmt, **options)
        out.data, out.steps = first.data, [f"{fmt}:{s}" for s in first.steps]
    except Exception as error:
        out.errors.append({"step": "format", "error": str(error)})
        return out

    def stage(name: str, action: Callable[[], None]) -> None:
        try:
            action()
            out.steps.append(name)
        except Exception as error:
            out.errors.append({"step": name, "error": str(error)})

    def run_core() -> None:
        out.data = run_steps(out.data, core or PLANS["core"], options).data

    def run_rules() -> None:
        out.validation = validate.validate(out.data, rules)

    def run_dedup() -> None:
        out.data = STRATEGIES[strategy](out.data, columns, order_by, strategy_options or {})

    stage("core", run_core)
    if rules:
        stage("validation", run_rules)
    if strategy:
        stage("deduplication", run_dedup)
    return out


def clean_documents(docs: DataFrame, key: str, col: str, schema: str | None = None, max_paths: int | None = None, **options) -> Cleaned:
    """Nested documents (JSON text) to one cleaned row each, list items under indexed paths."""
    parsed = nested.parse_json(docs.select(ref(key), ref(col)), col, schema)
    wide = nested.widen(parsed, [key], col, max_paths=max_paths)
    return clean(wide, "yaml", keys=[key], **options)

