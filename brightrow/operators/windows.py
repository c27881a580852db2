"""Rolling means, interpolation, forward fill and unique suffixes in row order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from brightrow.columns import choose_numbers, known_number, present, ref
from brightrow.operators.ordered import (
    CHUNK,
    PLACE,
    attach,
    chunk_sequence,
    chunk_summary,
    chunk_window,
    numbered,
    split_by_order,
)
from brightrow.session import durable

# Rows of a window from which on means come from sums of blocks: a frame is added up anew for every row.
WIDE_WINDOW = 100


def smooth(
    df: DataFrame,
    cols: Iterable[str] | None,
    order_by: Sequence[str],
    window: int = 3,
    by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Mean of the last ``window`` rows, missing values left out, from the first row on."""
    names = [c for c in choose_numbers(df, cols) if c not in {*by, *order_by}]
    if not names:
        return df
    if window >= WIDE_WINDOW and not any(isinstance(df.schema[c].dataType, T.DecimalType) for c in names):
        return _smooth_wide(df, names, order_by, window, by, rows_per_chunk)
    parts, chunks = split_by_order(df, by, order_by, rows_per_chunk)
    order = [PLACE] if chunks else order_by
    rolling = chunk_window(by, order).rowsBetween(-(window - 1), 0)
    if not chunks:
        means = {c: F.avg(known_number(df, c)).over(rolling) for c in names}
        return parts.withColumns(means).drop(CHUNK)

    # A chunk's first rows also need the last rows of the chunks before it: these are copied
    # into it as rows, take part in the window, and leave again.
    whole = parts.withColumn("__halo", F.lit(False)).unionByName(_halo(parts, by, order, window))
    means = {c: F.avg(known_number(df, c)).over(rolling) for c in names}
    return whole.withColumns(means).where(~F.col("__halo")).drop(CHUNK, PLACE, "__halo")


def _smooth_wide(
    df: DataFrame,
    names: Sequence[str],
    order_by: Sequence[str],
    window: int,
    by: Sequence[str],
    rows_per_chunk: int | None,
) -> DataFrame:
    """Rolling means at a cost per row that does not follow the width of the window.

    Each key is cut into blocks of ``window`` rows. A window is the end of one block and the
    beginning of the next, so its sum is a running sum from behind plus one from the front.
    Every row goes to its own block and to the next one; nothing is subtracted, so no large or
    infinite value outside a window touches its mean.
    """
    out, _ = numbered(df, by, order_by, "__pos", rows_per_chunk)
    out = out.drop(CHUNK).withColumn("__ahead", F.explode(F.array(F.lit(0), F.lit(window))))
    place = F.col("__pos") - 1
    out = out.withColumn("__start", place - place % window + F.col("__ahead"))
    own = F.col("__ahead") == 0
    block = Window.partitionBy(*[ref(c) for c in by], "__start")
    upto = block.orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    onward = block.orderBy(F.col("__pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    behind, ahead, means = {}, {}, {}
    for i, c in enumerate(names):
        value = known_number(df, c).cast("double")
        for kind, agg in (("s", F.sum), ("n", F.count)):
            behind[f"__b{kind}{i}"] = agg(F.when(~own, value)).over(onward)
            # From the row where the window begins, if that is in the block before; else nothing.
            earlier = F.lag(f"__b{kind}{i}", window - 1).over(block.orderBy("__pos"))
            here = agg(F.when(own, value)).over(upto)
            ahead[f"__{kind}{i}"] = F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0))
        means[c] = F.when(F.col(f"__n{i}") > 0, F.col(f"__s{i}") / F.col(f"__n{i}"))
    out = out.withColumns(behind).withColumns(ahead).where(own).withColumns(means)
    return out.drop("__pos", "__ahead", "__start", *behind, *ahead)


def _halo(parts: DataFrame, by: Sequence[str], order_by: Sequence[str], window: int) -> DataFrame:
    """Copies of rows for the later chunks of their key whose first rows reach back to them.

    A chunk gets at most ``window`` - 1 of them. What is needed to tell is one row per chunk.
    """
    counts = durable(chunk_summary(parts, by, F.count(F.lit(1)).alias("__n")))
    largest = counts.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0]
    before = F.coalesce(F.sum("__n").over(chunk_sequence(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("__before", before.cast("long"))
    # Chunks that begin before the window of the last row of this one ends.
    near = Window.partitionBy(*[ref(c) for c in by]).orderBy("__before").rangeBetween(1, largest + window)
    placed = placed.withColumn("__later", F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), F.col("__before").alias("begin"))).over(near))
    right = placed.select(*[ref(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(CHUNK).alias("__kc"), "__n", "__before", "__later")
    match = F.col(CHUNK) == F.col("__kc")
    for i, c in enumerate(by):
        match = match & ref(c).eqNullSafe(F.col(f"__k{i}"))
    rows = parts.withColumn("__pos", F.row_number().over(chunk_window(by, order_by)))
    last = rows.join(right, match & (F.col("__n") - F.col("__pos") < window - 1))
    place = F.col("__before") + F.col("__pos")
    reached = F.filter("__later", lambda t: t["begin"] - place < window - 1)
    copies = last.withColumn("__to", F.explode(reached)).withColumn(CHUNK, F.col("__to.chunk"))
    return copies.select(*[ref(c) for c in parts.columns]).withColumn("__halo", F.lit(True))


def _chunk_keys(by: Sequence[str]):
    return [*[ref(c) for c in by], F.col(CHUNK)]


def ffill(
    df: DataFrame,
    cols: Iterable[str] | None,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Fill each missing value with the last known one before it."""
    names = [c for c in (df.columns if cols is None else present(df, cols)) if c not in {*by, *order_by}]
    if not names:
        return df
    parts, chunks = split_by_order(df, by, order_by, rows_per_chunk)
    upto = chunk_window(by, [PLACE] if chunks else order_by).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(known_number(df, c), ignorenulls=True).over(upto) for c in names}
    if not chunks:
        return parts.withColumns(filled).drop(CHUNK)
    lasts = [
        F.max_by(known_number(df, c), F.when(known_number(df, c).isNotNull(), F.col(PLACE))).alias(f"__l{i}")
        for i, c in enumerate(names)
    ]
    summary = chunk_summary(parts, by, *lasts)
    before = chunk_sequence(by).rowsBetween(Window.unboundedPreceding, -1)
    carried = [f"__c{i}" for i in range(len(names))]
    carry = summary.withColumns(
        {f"__c{i}": F.last(f"__l{i}", ignorenulls=True).over(before) for i in range(len(names))}
    )
    out = attach(parts, carry, by, carried, chunks)
    return out.withColumns({c: F.coalesce(filled[c], F.col(f"__c{i}")) for i, c in enumerate(names)}).drop(
        CHUNK, PLACE, *carried
    )


def interpolate(
    df: DataFrame,
    cols: Iterable[str] | None,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Linear by row position: gaps are bridged, leading gaps stay, trailing ones hold the last value."""
    names = [c for c in choose_numbers(df, cols) if c not in {*by, *order_by}]
    if not names:
        return df
    out, chunks = numbered(df, by, order_by, "__pos", rows_per_chunk)
    # Looking ahead is a running window over the reversed order: a frame that ends
    # at the last row would be evaluated anew for every row.
    place = Window.partitionBy(*_chunk_keys(by))
    upto = place.orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    onward = place.orderBy(F.col("__pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    points, sides = {}, {}
    for i, c in enumerate(names):
        value = known_number(df, c).cast("double")
        points[f"__p{i}"] = F.when(value.isNotNull(), F.struct(F.col("__pos").alias("at"), value.alias("v")))
        sides[f"__a{i}"] = F.last(F.col(f"__p{i}"), ignorenulls=True).over(upto)
        sides[f"__b{i}"] = F.last(F.col(f"__p{i}"), ignorenulls=True).over(onward)
    out = out.withColumns(points).withColumns(sides)
    if chunks:
        ends = []
        for i in range(len(names)):
            at = F.col(f"__p{i}")["at"]
            ends += [F.max_by(f"__p{i}", at).alias(f"__l{i}"), F.min_by(f"__p{i}", at).alias(f"__f{i}")]
        sequence = chunk_sequence(by)
        before = sequence.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*[ref(c) for c in by]).orderBy(F.col(CHUNK).desc())
        after = after.rowsBetween(Window.unboundedPreceding, -1)
        carry = chunk_summary(out, by, *ends)
        carried = {}
        for i in range(len(names)):
            carried[f"__ca{i}"] = F.last(F.col(f"__l{i}"), ignorenulls=True).over(before)
            carried[f"__cb{i}"] = F.last(F.col(f"__f{i}"), ignorenulls=True).over(after)
        out = attach(out, carry.withColumns(carried), by, list(carried), chunks)
        joined = {}
        for i in range(len(names)):
            joined[f"__a{i}"] = F.coalesce(f"__a{i}", f"__ca{i}")
            joined[f"__b{i}"] = F.coalesce(f"__b{i}", f"__cb{i}")
        out = out.withColumns(joined).drop(*carried)
    updates = {}
    for i, c in enumerate(names):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        share = (F.col("__pos") - a["at"]) / (b["at"] - a["at"])
        bridged = F.when(a["at"] == b["at"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)
        updates[c] = F.when(a.isNull(), F.lit(None)).when(b.isNull(), a["v"]).otherwise(bridged)
    helpers = [f"__{k}{i}" for k in "pab" for i in range(len(names))]
    return out.withColumns(updates).drop(CHUNK, "__pos", *helpers)


def enforce_unique(
    df: DataFrame, col: str, order_by: Sequence[str], rows_per_chunk: int | None = None
) -> DataFrame:
    """Append ``_1``, ``_2``... to every repeat of a value, in the given order."""
    if col not in df.columns:
        return df
    out, _ = numbered(df, [col], order_by, "__pos", rows_per_chunk)
    suffixed = F.concat_ws("_", ref(col).cast("string"), (F.col("__pos") - 1).cast("string"))
    value = F.when((F.col("__pos") > 1) & ref(col).isNotNull(), suffixed).otherwise(ref(col).cast("string"))
    return out.withColumn(col, value).drop(CHUNK, "__pos")
