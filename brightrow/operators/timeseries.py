"""Resampling to regular bins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from brightrow.columns import choose_numbers, known_number, ref

# Bin units in microseconds.
UNITS = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}
# Bins generated from one row of the grid; longer spans are split over tasks.
GRID_BLOCK = 4096


def bin_micros(freq: str) -> int:
    found = re.fullmatch(r"(\d*)(s|min|h|D)", freq)
    if not found or found.group(1).strip("0") == "" != found.group(1):
        raise ValueError(f"unknown frequency {freq!r}")
    return int(found.group(1) or 1) * UNITS[found.group(2)]


def bin_means(
    df: DataFrame, ts_col: str, freq: str, cols: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Mean per bin that holds rows, with the bin's left edge as ``__bin`` micros."""
    width = bin_micros(freq)
    micros = F.unix_micros(ref(ts_col).cast("timestamp"))
    dated = df.where(ref(ts_col).isNotNull()).withColumn("__bin", micros - F.pmod(micros, F.lit(width)))
    means = [F.avg(known_number(df, c)).alias(c) for c in cols]
    grouped = dated.groupBy(*[ref(c) for c in by], "__bin")
    return grouped.agg(*means) if means else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")


def resample_mean(
    df: DataFrame,
    ts_col: str,
    freq: str = "1min",
    cols: Iterable[str] | None = None,
    by: Sequence[str] = (),
    fill_gaps: bool = True,
) -> DataFrame:
    """Mean of the numeric columns per bin, labelled by its left edge.

    Bins count from midnight UTC, for frequencies that divide a day. Empty bins
    between the first and the last of a group come out as null rows. Rows without
    a timestamp and columns that are neither numeric nor a key fall away.
    """
    names = [c for c in choose_numbers(df, cols) if c not in {ts_col, *by}]
    out = bin_means(df, ts_col, freq, names, by)
    if fill_gaps:
        out = _with_gaps(out, bin_micros(freq), by)
    kind = df.schema[ts_col].dataType
    edge = F.timestamp_micros("__bin").cast(kind.simpleString())
    return out.select(*[ref(c) for c in by], edge.alias(ts_col), *[ref(c) for c in names])


def _with_gaps(binned: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    keys = [ref(c) for c in by]
    span = binned.groupBy(*keys).agg(F.min("__bin").alias("lo"), F.max("__bin").alias("hi"))
    block = width * GRID_BLOCK
    # Two steps, with the blocks spread over tasks between them: the grid of one
    # group may be far longer than what one row should expand to.
    starts = span.where("lo is not null").withColumn(
        "start", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(block)))
    )
    stop = F.least(F.col("hi"), F.col("start") + F.lit(block - width))
    grid = starts.repartition(*keys, F.col("start")).select(
        *[c.alias(f"__g{i}") for i, c in enumerate(keys)],
        F.explode(F.sequence(F.col("start"), stop, F.lit(width))).alias("__gbin"),
    )
    match = F.col("__bin") == F.col("__gbin")
    for i, c in enumerate(keys):
        match = match & c.eqNullSafe(F.col(f"__g{i}"))
    joined = grid.join(binned, match, "left")
    others = [ref(c) for c in binned.columns if c not in {"__bin", *by}]
    return joined.select(
        *[F.col(f"__g{i}").alias(c) for i, c in enumerate(by)], F.col("__gbin").alias("__bin"), *others
    )
