"""Greedy deduplication along an ordered value: time windows and tolerances.

Per key, in value order, a row goes when it lies within ``width`` of the last
row that stayed. Where a row lands depends only on one number, the last value
kept before it, so the work splits into ranges of any key:

0. while no key exceeds a chunk, whole keys go to one partition each and step 4
   is all there is;
1. else rows are range-partitioned and sorted on (key, value), and each range is cut
   into chunks, of bounded size also for a key that holds most rows. Chunks may be small:
   a range is a task, and their number does not follow that of the chunks;
2. every chunk reports how the value kept before it maps to the value kept at
   its end, as a step function over the few rows it could start from;
3. the step functions are composed in a tree of groups of ``FAN_IN`` chunks,
   which gives each chunk the value kept before it. Composed functions may have as
   many steps as all chunks together, so where that is more than a chunk has rows
   (windows wider than chunks), the steps stay with their chunks: each step is a row
   that points to the step where its chain enters a later chunk, and the chains that
   begin with the keys are followed by doubling these pointers in joins;
4. every range filters its own rows, from the value kept before its first chunk on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightrow.columns import known_number, ref
from brightrow.operators.ordered import largest_key, place_in_range, range_count
from brightrow.operators.project import order_columns
from brightrow.session import durable, durable_partitions, free

FAN_IN = 16
ROWS_PER_CHUNK = 500_000
STEPS = "chunk long, first_key string, last_key string, low double, starts array<double>, ends array<double>"
PLACED_STEPS = STEPS.replace("chunk long", "range long, nth long")
# Chunks, and steps of them, that a task reports at a time.
REPORT_CHUNKS, REPORT_STEPS = 2000, 200_000


def dedup_time_window(
    df: DataFrame,
    ts_col: str,
    order_by: Sequence[str],
    seconds: float = 60,
    subset: Sequence[str] | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Drop rows at most ``seconds`` after the last kept row of the same key."""
    micros = F.unix_micros(ref(ts_col).cast("timestamp")).cast("double")
    return _thin(df, micros, subset or [], order_by, seconds * 1e6, rows_per_chunk)


def dedup_tolerance(
    df: DataFrame,
    col: str,
    order_by: Sequence[str],
    tol: float = 0.001,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Drop rows whose value lies within ``tol`` of the last kept value."""
    return _thin(df, known_number(df, col).cast("double"), [], order_by, tol, rows_per_chunk)


def _thin(
    df: DataFrame,
    value: Column,
    keys: Sequence[str],
    order_by: Sequence[str],
    width: float,
    rows_per_chunk: int | None,
) -> DataFrame:
    # Equal keys are equal JSON texts, nulls included.
    key = F.to_json(F.struct(*[ref(c) for c in keys])) if keys else F.lit("")
    rows = df.withColumns({"__key": key, "__value": value})
    known = rows.where("__value is not null")
    order = [F.col("__key"), F.col("__value"), *order_columns(order_by)]
    limit = rows_per_chunk or ROWS_PER_CHUNK
    largest, total = largest_key(known, ["__key"])
    if largest <= limit:
        # Every key fits a task: whole keys per partition, nothing to carry.
        placed = known.withColumn("__carried", F.lit(None).cast("double")).repartition("__key")
        kept = placed.sortWithinPartitions(*order).mapInArrow(_filter(width), placed.schema)
    else:
        ranged = durable_partitions(
            known.repartitionByRange(range_count(df.sparkSession, total, limit), *order)
            .sortWithinPartitions(*order)
            .withColumns(
                {"__range": F.spark_partition_id().cast("long"), "__nth": F.floor(place_in_range() / limit)}
            )
        )
        reported = durable(
            ranged.select("__range", "__nth", "__key", "__value").mapInArrow(_reporter(width), PLACED_STEPS)
        )
        sizes = reported.agg(F.sum(F.size("starts")).alias("steps"), F.max("nth").alias("nth")).first()
        per_range = (sizes["nth"] or 0) + 1
        steps = reported.withColumn("chunk", F.col("range") * per_range + F.col("nth")).drop("range", "nth")
        entered = _jumped(steps, width) if (sizes["steps"] or 0) > limit else _carried(steps, width)
        # One row per range: a task carries on from its first chunk to the next ones itself.
        first = entered.where(F.col("chunk") % per_range == 0)
        carried = durable(
            first.select((F.col("chunk") / per_range).cast("long").alias("__range"), F.col("carried").alias("__carried"))
        )
        free(reported)
        entering = ranged.join(F.broadcast(carried), "__range", "left").drop("__range", "__nth")
        kept = entering.mapInArrow(_filter(width), entering.schema)
    helpers = ["__key", "__value", "__carried"]
    # Rows without a value never match one another.
    unknown = rows.where("__value is null")
    return kept.drop(*helpers).unionByName(unknown.drop(*helpers))


def first_beyond(values: np.ndarray, anchors: np.ndarray, width: float) -> np.ndarray:
    """Index of the first sorted value with ``value - anchor > width``, per anchor."""
    at = np.searchsorted(values, anchors + width, side="right")
    # Rounding of the sum can be off by a value; settle by the difference itself.
    while True:
        inside = at < len(values)
        ahead = inside & (values[np.minimum(at, len(values) - 1)] - anchors <= width)
        behind = (at > 0) & (values[np.maximum(at - 1, 0)] - anchors > width)
        if not ahead.any() and not behind.any():
            return at
        at = at + ahead.astype(int) - (behind & ~ahead).astype(int)


class _Chunk:
    """Rows of one chunk, in order, of which the values of the last key are held."""

    def __init__(self, place: tuple[int, int], key: str):
        self.place, self.first, self.last = place, key, key
        self.values: list[np.ndarray] = []
        self.several = False

    def add(self, keys: pa.Array, values: np.ndarray) -> None:
        final = keys[len(keys) - 1].as_py()
        if final != self.last:
            self.several, self.values, self.last = True, [], final
        same = pc.equal(keys, final).to_numpy(zero_copy_only=False)
        self.values.append(values[same])

    def row(self, width: float) -> dict:
        run = np.unique(np.concatenate(self.values))
        begin, end = _steps(run, width)
        if self.several:  # the chunk's last key starts inside it: nothing carries through
            begin, end = np.array([np.inf]), end[:1]
        return {
            "range": self.place[0],
            "nth": self.place[1],
            "first_key": self.first,
            "last_key": self.last,
            "low": float(run[0]),
            "starts": begin,
            "ends": end,
        }


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """The chunks of a range, one after the other."""
    chunk = None
    for batch in batches:
        if not batch.num_rows:
            continue
        nth = batch.column("__nth").to_numpy(zero_copy_only=False)
        values = batch.column("__value").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), len(nth)]
        for low, high in zip(edges, edges[1:]):
            keys = batch.column("__key").slice(low, high - low)
            place = batch.column("__range")[low].as_py(), int(nth[low])
            if chunk is None or chunk.place != place:
                if chunk is not None:
                    yield chunk
                chunk = _Chunk(place, keys[0].as_py())
            chunk.add(keys, values[low:high])
    if chunk is not None:
        yield chunk


def _reporter(width: float):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for chunk in _chunks(batches):
            rows.append(chunk.row(width))
            size += len(rows[-1]["starts"])
            if len(rows) >= REPORT_CHUNKS or size >= REPORT_STEPS:
                yield from pa.Table.from_pylist(rows).to_batches()
                rows, size = [], 0
        if rows:
            yield from pa.Table.from_pylist(rows).to_batches()

    return report


def _steps(run: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the chain may enter at: the row it leaves at."""
    following = first_beyond(run, run, width)
    size = len(run)
    leave = np.append(np.where(following == size, np.arange(size), following), size)
    while True:  # pointer doubling to the end of each chain
        further = leave[leave]
        if (further == leave).all():
            break
        leave = further
    reachable = min(size, int(first_beyond(run, run[:1], width)[0]) + 1)
    return _compress(run[:reachable], run[leave[:reachable]])


def _compress(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring entries that leave at the same row become one step."""
    last_of_step = np.append(end[1:] != end[:-1], True)
    return begin[last_of_step], end[last_of_step]


def _apply(begin: np.ndarray, end: np.ndarray, anchors: np.ndarray, width: float) -> np.ndarray:
    at = first_beyond(begin, anchors, width)
    return np.where(at < len(begin), end[np.minimum(at, len(begin) - 1)], anchors)


def _ordered(pdf: pd.DataFrame) -> Iterable:
    for row in pdf.sort_values("chunk").itertuples(index=False):
        yield row, np.asarray(row.starts, dtype=float), np.asarray(row.ends, dtype=float)


def _composer(width: float):
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = end = first = last = low = None
        for row, b, e in _ordered(pdf):
            if begin is None:
                begin, end, first, low = b, e, row.first_key, row.low
            elif row.first_key != last:
                begin, end = np.array([np.inf]), e[:1]
            else:
                end = _apply(b, e, end, width)
                fresh = b > begin[-1]
                begin, end = np.append(begin, b[fresh]), np.append(end, e[fresh])
                reachable = int(first_beyond(begin, np.array([low]), width)[0]) + 1
                begin, end = _compress(begin[:reachable], end[:reachable])
            last = row.last_key
        group = int(pdf["parent"].iloc[0])
        return pd.DataFrame(
            {
                "chunk": [group],
                "first_key": [first],
                "last_key": [last],
                "low": [low],
                "starts": [begin],
                "ends": [end],
            }
        )

    return compose


def _walker(width: float):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        entering = pdf["entering"].iloc[0]
        carried = None if pd.isna(entering) else float(entering)
        last = None
        chunks, values = [], []
        for row, begin, end in _ordered(pdf):
            if last is not None and row.first_key != last:
                carried = None
            chunks.append(row.chunk)
            values.append(carried)
            carried = float(end[0] if carried is None else _apply(begin, end, np.array([carried]), width)[0])
            last = row.last_key
        return pd.DataFrame({"chunk": chunks, "carried": pd.array(values, dtype="Float64")})

    return walk


def _carried(steps: DataFrame, width: float) -> DataFrame:
    """The value kept before each chunk, null when its first key starts in it."""
    grouped = steps.withColumn("parent", F.floor(F.col("chunk") / FAN_IN))
    if steps.count() <= FAN_IN:
        entered = grouped.withColumn("parent", F.lit(0)).withColumn("entering", F.lit(None).cast("double"))
    else:
        parents = durable(grouped.groupBy("parent").applyInPandas(_composer(width), STEPS))
        above = _carried(parents, width).select(F.col("chunk").alias("parent"), F.col("carried").alias("entering"))
        entered = grouped.join(above, "parent")
    return entered.groupBy("parent").applyInPandas(_walker(width), "chunk long, carried double")


def _jumped(steps: DataFrame, width: float) -> DataFrame:
    """As :func:`_carried`; no array is longer than a chunk, and no round handles chunk after chunk.

    A step is named by chunk and place. Of the pointers over 2, 4, 8, ... chunks entered, only
    those are kept that start where a chain can be after so many; chains that meet go on as one.
    """
    single = F.col("first_key") == F.col("last_key")
    pieces = steps.select(
        F.col("last_key").alias("key"),
        "chunk",
        # The last step of a chunk lies beyond a value kept earlier if any row of it does.
        F.when(single, F.element_at("starts", -1)).otherwise(F.col("low")).alias("high"),
        F.array_min("ends").alias("least"),
        F.array_max("ends").alias("most"),
    )
    # One row per chunk. Ends lie in their chunk and targets do not fall, so pairs are at most twice as many.
    pairs = pieces.groupBy("key").applyInPandas(_stairs(width), "source long, target long, below double, high double")
    sources = steps.select(F.col("chunk").alias("source"), "ends")
    targets = steps.select(F.col("chunk").alias("target"), "starts")
    met = pairs.join(sources, "source").join(targets, "target")
    jumps = [durable(met.mapInArrow(_pointers(width), "src long, dst long"))]
    roots = durable(pieces.groupBy("key").agg(F.min("chunk").alias("chunk")).select(_step("chunk").alias("src")))
    while True:
        jump = jumps[-1]
        reached = roots.union(jump.select(F.col("dst").alias("src"))).distinct()
        near = jump.join(reached, "src", "leftsemi").select("src", F.col("dst").alias("via"))
        further = durable(near.join(jump.withColumnRenamed("src", "via"), "via").select("src", "dst"))
        if further.isEmpty():
            free(further)
            break
        jumps.append(further)
    chain = roots
    for jump in reversed(jumps):
        longer = durable(chain.union(chain.join(jump, "src").select("dst")))
        free(jump, chain)
        chain = longer
    at = chain.select(F.shiftright("src", 32).alias("chunk"), F.col("src").bitwiseAND(2**32 - 1).cast("int").alias("at"))
    left = steps.join(at, "chunk").select(
        F.col("last_key").alias("key"), "chunk", F.get("ends", F.col("at")).alias("end"), F.lit(1).alias("kind")
    )
    asked = steps.select(F.col("first_key").alias("key"), "chunk", F.lit(None).cast("double").alias("end"), F.lit(0).alias("kind"))
    earlier = Window.partitionBy("key").orderBy("chunk", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("end", ignorenulls=True).over(earlier)
    return asked.unionByName(left).withColumn("carried", carried).where("kind = 0").select("chunk", "carried")


def _step(chunk: str) -> Column:
    return F.shiftleft(F.col(chunk).cast("long"), 32)


def _stairs(width: float):
    """The later chunks that the steps of each chunk of a key enter."""

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = pdf.sort_values("chunk")
        chunks, highs = pieces["chunk"].to_numpy(), pieces["high"].to_numpy()
        begin = first_beyond(highs, pieces["least"].to_numpy(), width)
        end = np.minimum(first_beyond(highs, pieces["most"].to_numpy(), width) + 1, len(chunks))
        count = np.maximum(end - begin, 0)
        source = np.repeat(np.arange(len(chunks)), count)
        target = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return pd.DataFrame(
            {"source": chunks[source], "target": chunks[target], "below": highs[target - 1], "high": highs[target]}
        )

    return pair


def _pointers(width: float):
    """Steps of a chunk that go on in a given later one, with the step they enter there."""

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ends = row["ends"].values.to_numpy(zero_copy_only=False)
                starts = row["starts"].values.to_numpy(zero_copy_only=False)
                edges = np.array([row["below"].as_py(), row["high"].as_py()])
                here = np.flatnonzero(first_beyond(edges, ends, width) == 1)
                entry = first_beyond(starts, ends[here], width)
                src = (row["source"].as_py() << 32) + here
                dst = (row["target"].as_py() << 32) + entry
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return point


def _filter(width: float):
    """Rows that stay, in order; ``__carried`` is the value kept last for the first row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column("__key"), batch.column("__value").to_numpy(zero_copy_only=False)
            if not begun:
                key, begun = keys[0].as_py(), True
                anchor = batch.column("__carried")[0].as_py()
            new_key = np.empty(len(values), dtype=bool)
            new_key[0] = keys[0].as_py() != key
            if len(values) > 1:
                new_key[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(values), dtype=bool)
            begins = np.flatnonzero(new_key).tolist()
            if not new_key[0]:
                begins.insert(0, 0)
            for low, high in zip(begins, [*begins[1:], len(values)]):
                run = values[low:high]
                enter = 0
                if not new_key[low] and anchor is not None:
                    enter = int(first_beyond(run, np.array([anchor]), width)[0])
                # From each kept row to the next: one step per kept row.
                following = first_beyond(run, run, width).tolist()
                while enter < len(run):
                    keep[low + enter] = True
                    anchor = run[enter]
                    enter = following[enter]
            key = keys[len(keys) - 1].as_py()
            yield batch.filter(pa.array(keep))

    return run
