"""Ingest of many files of several formats."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brightrow.sources import readers
from brightrow.sources.sinks import stage

# File endings and their formats.
FORMATS = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".parquet": "parquet",
    ".orc": "orc",
    ".xml": "xml",
    ".log": "log",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".avro": "avro",
}


def detect_format(name: str) -> str:
    ending = PurePosixPath(name).suffix.lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file type {ending!r}")
    return FORMATS[ending]


def read_files(spark: SparkSession, fmt: str, paths: Sequence[str], row_tag: str = "record") -> DataFrame:
    """All files of one format in one scan."""
    many = list(paths)
    if fmt == "csv":
        return readers.read_csv(spark, many)
    if fmt in ("json", "jsonl"):
        return readers.read_json(spark, many, lines=fmt == "jsonl")
    if fmt == "parquet":
        return spark.read.parquet(*many)
    if fmt == "orc":
        return spark.read.orc(many)
    single = {
        "xml": lambda p: readers.read_xml(spark, p, row_tag),
        "log": lambda p: readers.read_logs(spark, p),
        "yaml": lambda p: readers.read_yaml(spark, p),
        "avro": lambda p: readers.read_avro(spark, p),
    }
    if fmt not in single:
        raise ValueError(f"unsupported format {fmt!r}")
    return single[fmt](",".join(many) if fmt == "xml" else many)


def ingest_files(
    spark: SparkSession,
    paths: Sequence[str],
    staging_dir: str,
    validate: Callable[[DataFrame], bool] | None = None,
    row_tag: str = "record",
) -> DataFrame:
    """Stage files as parquet and report (source, format, status, reason, staged).

    Without a check, all files of a format are read and written by one job. With
    ``validate``, which judges one file at a time, each file is its own job and a
    rejected or unreadable file leaves the others alone.
    """
    report, groups = [], defaultdict(list)
    for path in paths:
        try:
            groups[detect_format(path)].append(path)
        except ValueError as error:
            report.append((path, None, "failed", str(error), None))
    for fmt, members in groups.items():
        units = [members] if validate is None else [[p] for p in members]
        for unit in units:
            report += _ingest_unit(spark, fmt, unit, staging_dir, validate, row_tag)
    return spark.createDataFrame(
        report, "source string, format string, status string, reason string, staged string"
    )


def ingest_checked_files(
    spark: SparkSession, paths: Sequence[str], staging_dir: str, accept: Column, row_tag: str = "record"
) -> DataFrame:
    """As :func:`ingest_files`, with a check that one job makes for all files of a format.

    ``accept`` is an aggregate over the rows of a file, such as ``count_if(id IS NULL) = 0``;
    where it is not true the file is rejected and its rows are left out of what is staged. A
    file without rows is accepted. If a format cannot be read at once, or the check does not
    fit its columns, its files are reported as failed. Formats whose reader hides where a row
    comes from (xml, yaml, log) are not taken here.
    """
    report, groups = [], defaultdict(list)
    for path in paths:
        try:
            fmt = detect_format(path)
            if fmt in ("xml", "yaml", "log"):
                raise ValueError(f"rows of {fmt} do not tell their file")
            groups[fmt].append(path)
        except ValueError as error:
            report.append((path, None, "failed", str(error), None))
    for fmt, members in groups.items():
        try:
            rows = read_files(spark, fmt, members, row_tag)
            located = rows.select("*", F.col("_metadata.file_path").alias("__file"))
            verdicts = located.groupBy("__file").agg(F.coalesce(accept, F.lit(False)).alias("ok"))
            bad = [r["__file"] for r in verdicts.where("NOT ok").select("__file").collect()]
            rejected = {p for p in members if any(_belongs(f, p) for f in bad)}
            good = [p for p in members if p not in rejected]
            target = None
            if good:
                # Parts of a rejected folder go with it.
                parts = reduce(lambda a, b: a | b, [_inside(F.col("__file"), p) for p in rejected], F.lit(False))
                kept = located.where(~parts).drop("__file").select("*", F.lit(fmt).alias("__format"))
                target = stage(kept, staging_dir, _folder(fmt, good))
            for p in members:
                state = ("rejected", "validation failed", None) if p in rejected else ("staged", None, target)
                report.append((p, fmt, *state))
        except Exception as error:  # one format must not stop the others
            report += [(p, fmt, "failed", str(error).splitlines()[0], None) for p in members]
    return spark.createDataFrame(
        report, "source string, format string, status string, reason string, staged string"
    )


def _plain(path: str) -> str:
    """A path as files report it: without scheme, and escaped as in a URI."""
    return quote(re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/"), safe="/!$&'()*+,;=:@~")


def _belongs(file: str, path: str) -> bool:
    found = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", file)
    return found == _plain(path) or found.startswith(_plain(path) + "/")


def _inside(file: Column, path: str) -> Column:
    found = F.regexp_replace(file, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    return (found == _plain(path)) | found.startswith(_plain(path) + "/")


def _folder(fmt: str, paths: Sequence[str]) -> str:
    """A folder of its own for a set of sources: files of one name do not meet in it."""
    digest = hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:12]
    stem = PurePosixPath(paths[0]).stem if len(paths) == 1 else "files"
    return f"{fmt}-{stem}-{digest}"


def _ingest_unit(spark, fmt, unit, staging_dir, validate, row_tag):
    name = _folder(fmt, unit)
    try:
        df = read_files(spark, fmt, unit, row_tag)
        if validate is not None and not validate(df):
            return [(p, fmt, "rejected", "validation failed", None) for p in unit]
        # Column names that parquet or SQL would not take plainly are kept by quoting.
        target = stage(df.select("*", F.lit(fmt).alias("__format")), staging_dir, name)
        return [(p, fmt, "staged", None, target) for p in unit]
    except Exception as error:  # one bad file must not stop the rest
        if validate is None and len(unit) > 1:
            out = []
            for p in unit:
                try:
                    target = stage(
                        read_files(spark, fmt, [p], row_tag).select("*", F.lit(fmt).alias("__format")),
                        staging_dir,
                        _folder(fmt, [p]),
                    )
                    out.append((p, fmt, "staged", None, target))
                except Exception as single:
                    out.append((p, fmt, "failed", str(single).splitlines()[0], None))
            return out
        return [(p, fmt, "failed", str(error).splitlines()[0], None) for p in unit]
