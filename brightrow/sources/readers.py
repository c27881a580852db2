"""File readers. Each returns a lazy DataFrame; Spark splits the files into tasks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brightrow.columns import present, ref
from brightrow.functions.dates import parse_timestamp
from brightrow.functions.text import group_names, java_pattern, strip
from brightrow.operators.nested import flatten, json_schema, last_repeated
from brightrow.operators.nulls import fill_map

Types = Mapping[str, str]


def enforce_schema(df: DataFrame, types: Types | None, strict: bool = True) -> DataFrame:
    """Cast the listed columns; a missing column or (strict) an uncastable value is an error.

    Strict mode counts the uncastable values of all columns in one aggregate.
    """
    if not types:
        return df
    absent = [c for c in types if c not in df.columns]
    if absent:
        raise ValueError(f"missing expected columns: {absent}")
    if strict:
        lost = [
            F.count_if(ref(c).isNotNull() & ref(c).try_cast(t).isNull()).alias(f"n{i}")
            for i, (c, t) in enumerate(types.items())
        ]
        row = df.agg(*lost).first()
        bad = [c for i, c in enumerate(types) if row[f"n{i}"]]
        if bad:
            raise ValueError(f"values that cannot be cast in columns: {bad}")
    return df.withColumns({c: ref(c).cast(t) for c, t in types.items()})


def read_clean(df: DataFrame, drop_duplicates: bool = True, fill: Mapping[str, object] | None = None) -> DataFrame:
    out = df.dropDuplicates() if drop_duplicates else df
    return fill_map(out, fill or {})


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: Types | None = None,
    delimiter: str = ",",
    encoding: str = "utf-8",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with header. Give ``schema`` for large inputs: it saves the inference pass.

    ``multi_line`` allows line breaks inside quotes, at the price of unsplit files.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", schema is None)
    )
    return enforce_schema(reader.csv(path), schema)


def read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: Types | None = None,
    sep: str = ".",
    lines: bool = True,
    struct: T.StructType | str | None = None,
) -> DataFrame:
    """One JSON object per line (splittable), flattened; without ``lines``, one document per file."""
    reader = spark.read.option("multiLine", not lines)
    if struct is not None:
        reader = reader.schema(struct)
    return enforce_schema(flatten(reader.json(path), sep), schema)


def read_parquet(spark: SparkSession, path: str, schema: Types | None = None) -> DataFrame:
    return enforce_schema(spark.read.parquet(path), schema)


def read_orc(spark: SparkSession, path: str, schema: Types | None = None) -> DataFrame:
    return enforce_schema(spark.read.orc(path), schema)


def read_avro(
    spark: SparkSession, path: str, schema: Types | None = None, avro_schema: str | None = None
) -> DataFrame:
    """Avro files; needs the spark-avro package on the session's class path."""
    reader = spark.read.format("avro")
    if avro_schema:
        reader = reader.option("avroSchema", avro_schema)
    try:
        raw = reader.load(path)
    except AnalysisException as error:
        if "data source" in str(error) and "avro" in str(error).lower():
            raise RuntimeError("reading Avro needs the spark-avro package on the session") from error
        raise
    return enforce_schema(raw, schema)


def read_xml(
    spark: SparkSession,
    path: str,
    row_tag: str,
    schema: Types | None = None,
    sep: str = ".",
    repeated: str = "last",
) -> DataFrame:
    """One row per ``row_tag`` element, flattened; attributes are ``@name``.

    Of repeated children the last one stays, or all as an array (``repeated="keep"``).
    """
    raw = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("attributePrefix", "@")
        .option("ignoreNamespace", True)
        .load(path)
    )
    flat = flatten(last_repeated(raw) if repeated == "last" else raw, sep)
    # An element with both text and attributes: its text carries the element's own name.
    tail = f"{sep}_VALUE"
    flat = flat.withColumnsRenamed({c: c[: -len(tail)] for c in flat.columns if c.endswith(tail)})
    return enforce_schema(flat, schema)


# The two line layouts of system logs.
SYSLOG = r"^(?P<timestamp>\S+ \S+) (?P<host>\S+) (?P<process>\S+): (?P<message>.*)$"
SYSLOG_CLASSIC = (
    r"^(?P<timestamp>\w{3}\s+\d{1,2}\s[\d:]+)\s+(?P<host>\S+)\s+(?P<service>[\w\-/]+):\s(?P<message>.*)$"
)


def read_logs(
    spark: SparkSession,
    path: str,
    kind: str = "text",
    pattern: str | None = None,
    keep_unmatched: bool = False,
    struct: T.StructType | str | None = None,
) -> DataFrame:
    """Log lines as columns; blank lines drop out.

    ``json`` drops lines that are no JSON. ``syslog`` drops lines in another layout,
    or with ``keep_unmatched`` reads the classic layout and keeps others in ``line``.
    ``text`` applies a pattern with named groups, or gives ``raw_line``.
    """
    if kind == "json":
        reader = spark.read.option("mode", "DROPMALFORMED")
        return (reader.schema(struct) if struct is not None else reader).json(path)
    if kind not in ("text", "syslog"):
        raise ValueError(f"unknown log kind {kind!r}")
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    if kind == "syslog":
        return parse_lines(lines, "line", SYSLOG_CLASSIC if keep_unmatched else SYSLOG, keep_unmatched)
    if pattern is None:
        return lines.withColumnRenamed("line", "raw_line")
    return parse_lines(lines, "line", pattern)


def parse_lines(df: DataFrame, col: str, pattern: str, keep_unmatched: bool = False) -> DataFrame:
    """Named groups of a pattern that must match at the start of the line, as columns."""
    names, java = group_names(pattern), java_pattern(pattern)
    java = java if java.startswith("^") else f"^(?:{java})"
    hit = ref(col).rlike(java)
    fields = [F.when(hit, F.regexp_extract(ref(col), java, i + 1)).alias(n) for i, n in enumerate(names)]
    if keep_unmatched:
        return df.select(*fields, F.when(~hit, ref(col)).alias("line"))
    return df.where(hit).select(*fields)


def read_yaml(
    spark: SparkSession, path: str, required_keys: Sequence[str] = (), sep: str = ".", schema: str | None = None
) -> DataFrame:
    """A folder of YAML documents: one row per document, or per item of a list document."""
    texts = yaml_documents(spark, path)
    if required_keys:
        have = [F.try_variant_get(F.try_parse_json("json"), f"$.{k}", "variant").isNull() for k in required_keys]
        counts = texts.agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(have)]).first()
        absent = [k for i, k in enumerate(required_keys) if counts[f"n{i}"]]
        if absent:
            raise ValueError(f"missing expected keys: {absent}")
    kind = schema or json_schema(texts, "json")
    parsed = texts.select("path", F.from_json("json", kind).alias("doc"))
    return flatten(parsed.select("doc.*"), sep)


# Rows and characters that a YAML task hands over at a time.
YAML_ROWS, YAML_CHARACTERS = 10_000, 8_000_000


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) per YAML document or item of a list document; files are parsed where Spark reads them.

    Of a list only one item at a time is held as objects, besides what its anchors name.
    """
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        rows, size = [], 0
        for batch in batches:
            for name, text in zip(batch["file_path"], batch["value"]):
                for item in yaml_items(text):
                    rows.append((name, json.dumps(item, default=str, ensure_ascii=False)))
                    size += len(rows[-1][1])
                    if len(rows) >= YAML_ROWS or size >= YAML_CHARACTERS:
                        yield pd.DataFrame(rows, columns=["path", "json"])
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=["path", "json"])

    return files.mapInPandas(run, "path string, json string")


def yaml_items(text: str) -> Iterator[object]:
    """The items of a YAML text's list, one after the other; any other document is one item."""
    import yaml

    loader = yaml.SafeLoader(text)
    try:
        loader.get_event()  # the stream's start
        if loader.check_event(yaml.StreamEndEvent):
            yield None
            return
        start = loader.get_event()
        first = loader.peek_event()
        plain = isinstance(first, yaml.SequenceStartEvent) and first.anchor is None
        if plain and first.tag in (None, "!", loader.DEFAULT_SEQUENCE_TAG):
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                yield loader.construct_document(loader.compose_node(None, None))
            loader.get_event()
        else:
            loaded = loader.construct_document(loader.compose_node(None, None))
            yield from loaded if isinstance(loaded, list) else [loaded]
        loader.get_event()  # the document's end
        if not loader.check_event(yaml.StreamEndEvent):
            raise yaml.composer.ComposerError(
                "expected a single document in the stream",
                start.start_mark,
                "but found another document",
                loader.get_event().start_mark,
            )
    finally:
        loader.dispose()


def normalize_sensor(df: DataFrame, ts_col: str = "timestamp", expected: Sequence[str] = ()) -> DataFrame:
    """Flatten, drop equal rows, read timestamps, drop undated rows and order by time."""
    import warnings

    out = flatten(df).dropDuplicates()
    absent = [c for c in expected if c not in out.columns]
    if absent:
        warnings.warn(f"missing expected columns: {absent}", stacklevel=2)
    if ts_col not in present(out, [ts_col]):
        return out
    if isinstance(out.schema[ts_col].dataType, T.StringType):
        out = out.withColumn(ts_col, parse_timestamp(ref(ts_col)))
    return out.where(ref(ts_col).isNotNull()).orderBy(ref(ts_col))


def read_table(
    spark: SparkSession, name: str, filters: Mapping[str, object] | None = None, limit: int | None = None
) -> DataFrame:
    """A catalog table with ANDed equality filters, which reach the scan."""
    df = spark.table(name)
    for col, value in (filters or {}).items():
        df = df.where(ref(col) == F.lit(value))
    return df if limit is None else df.limit(limit)


def jdbc_options(
    url: str,
    query: str,
    fetchsize: int = 1000,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the query runs in parallel slices."""
    out = {"url": url, "fetchsize": str(fetchsize), **(properties or {})}
    if partition_column is None:
        return {**out, "query": query}
    if None in (lower, upper, partitions):
        raise ValueError("a partitioned read needs lower, upper and partitions")
    return {
        **out,
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
