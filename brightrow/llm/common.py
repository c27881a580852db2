"""Shared helpers of the corpus operators: column choice, Arrow batches, text buffers, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BATCH_ROWS = 1_000
BATCH_BYTES = 16 * 1024 * 1024


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name; other columns may share a name in another case or repeat it."""
    places = [df.columns.index(n) for n in names]
    return numbered_columns(df).select(*[F.col(f"_{i}").alias(n) for i, n in zip(places, names)])


def numbered_columns(df: DataFrame) -> DataFrame:
    """All columns, renamed to ``_0``, ``_1``, ... so that no name clashes."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor, F.lit(0))


def batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes, so that long texts do not pile up."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def annotate(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    results: str,
    work: Callable[[list[bytes | None]], Sequence],
) -> DataFrame:
    """Per-text results beside the ``keep`` columns.

    ``work`` maps the UTF-8 texts of a batch to one sequence per result column. A kept
    column that is named as a result gives way to it.
    """
    found = T.StructType.fromDDL(results)
    names = {f.name for f in found}
    kept = [c for c in keep if c not in names]
    source = pick(df, *dict.fromkeys([*kept, text]))
    schema = T.StructType([*[source.schema[c] for c in kept], *found])

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for chunk in chunks:
            texts = as_bytes(chunk.column(chunk.schema.get_field_index(text)))
            columns = work(texts)
            arrow = arrow or to_arrow(found)
            made = [pa.array(c, type=t) for c, t in zip(columns, arrow)]
            old = [chunk.column(chunk.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *made], names=[*kept, *[f.name for f in found]])

    return batches(source, run, schema)


def to_arrow(schema: T.StructType) -> list[pa.DataType]:
    plain = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.StringType(): pa.string(),
        T.DoubleType(): pa.float64(),
        T.BooleanType(): pa.bool_(),
        T.BinaryType(): pa.binary(),
    }
    out = []
    for field in schema:
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            out.append(pa.list_(plain[kind.elementType]))
        else:
            out.append(plain[kind])
    return out


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, without decoding them."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def groups(texts: Sequence[bytes], most: int = 1024 * 1024) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: Sequence[bytes], separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer with a separator after each text, and where each text starts."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(separator.join(texts) + separator, dtype=np.uint8), starts


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + sizes[i]``, one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(total)
