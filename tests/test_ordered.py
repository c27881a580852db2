"""Order-dependent operators, whole and split into chunks, against plain models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from brightrow.operators import anchors, windows

VALUES = st.lists(st.integers(0, 60), min_size=1, max_size=40)


def greedy(values, width):
    """Positions kept of ascending values."""
    kept, anchor = [], None
    for i, v in enumerate(values):
        if anchor is None or v - anchor > width:
            kept.append(i)
            anchor = v
    return kept


@settings(max_examples=300, deadline=None)
@given(VALUES, st.integers(1, 15), st.integers(1, 9))
def test_step_functions_carry_the_anchor(values, width, size):
    """Composed chunk summaries give every chunk the value kept before it."""
    values = np.sort(np.array(values, dtype=float))
    chunks = [values[i : i + size] for i in range(0, len(values), size)]
    rows = []
    for n, chunk in enumerate(chunks):
        run = np.unique(chunk)
        begin, end = anchors._steps(run, width)
        rows.append((n, "k", "k", float(run[0]), begin, end))
    frame = pd.DataFrame(rows, columns=["chunk", "first_key", "last_key", "low", "starts", "ends"])
    walked = anchors._walker(width)(frame.assign(parent=0, entering=None))
    kept = values[greedy(values, width)]
    for n, chunk in enumerate(chunks):
        expected = [v for v in kept if any(v == x for c in chunks[:n] for x in c)]
        carried = walked["carried"][n]
        if expected:
            assert carried == expected[-1]
        else:
            assert pd.isna(carried)
    # A composed group maps an entering value as its chunks do one by one.
    composed = anchors._composer(width)(frame.assign(parent=0)).iloc[0]
    for entering in np.arange(values[0] - 20, values[0], 1.0):
        one = np.array([entering])
        for _, chunk in frame.iterrows():
            one = anchors._apply(chunk.starts, chunk.ends, one, width)
        assert anchors._apply(composed.starts, composed.ends, np.array([entering]), width)[0] == one[0]


@pytest.mark.parametrize("width", [0.1, 0.3])
def test_first_beyond_uses_the_difference(width):
    values = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])
    got = anchors.first_beyond(values, values, width)
    want = [next((j for j, v in enumerate(values) if v - a > width), len(values)) for a in values]
    assert got.tolist() == want


def readings(seed, n=400, keys=3):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            # The first key holds most of the rows.
            "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, keys + 1, n)),
            "t": rng.integers(0, 500, n),
            "v": np.where(rng.random(n) < 0.4, np.nan, rng.integers(0, 100, n).astype(float)),
        }
    )
    return frame


def to_spark(spark, frame):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(
        [(int(a), int(b), int(c), None if d is None else float(d)) for a, b, c, d in rows],
        "id long, k int, t int, v double",
    )


@pytest.mark.parametrize("chunk", [None, 7, 40])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_thinning(spark, chunk, by):
    frame = readings(1)
    frame["v"] = frame["t"] / 10
    got = {
        r["id"]
        for r in anchors._thin(
            to_spark(spark, frame), F.col("v"), by, ["id"], 1.5, chunk
        ).collect()
    }
    want = set()
    groups = [frame] if not by else [g for _, g in frame.groupby("k")]
    for g in groups:
        g = g.sort_values(["v", "id"]).reset_index(drop=True)
        want |= set(g["id"][greedy(list(g["v"]), 1.5)])
    assert got == want


@pytest.mark.parametrize("width", [0, 1, 40, 300, 2_500])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_thinning_with_windows_of_many_chunks(spark, width, by):
    """Evenly spread values, whose chains never meet, dense and sparse stretches, and gaps."""
    rng = np.random.default_rng(width)
    times = np.concatenate([np.arange(0, 3_000, 3), rng.integers(5_000, 5_200, 600), rng.integers(9_000, 30_000, 400)])
    frame = pd.DataFrame({"id": np.arange(len(times)), "k": np.where(rng.random(len(times)) < 0.8, 0, 1), "t": 0, "v": times / 8})
    got = {r["id"] for r in anchors._thin(to_spark(spark, frame), F.col("v"), by, ["id"], width / 8, 50).collect()}
    want = set()
    for g in [frame] if not by else [g for _, g in frame.groupby("k")]:
        g = g.sort_values(["v", "id"]).reset_index(drop=True)
        want |= set(g["id"][greedy(list(g["v"]), width / 8)])
    assert got == want


def test_wide_windows_keep_steps_in_their_chunks(spark, monkeypatch):
    """Past a chunk's rows of steps, pointers are followed instead of composing step functions."""
    composed = []
    monkeypatch.setattr(anchors, "_carried", lambda *a: composed.append(a))
    rows = spark.range(2_000).selectExpr("id", "double(id) AS v")
    kept = {r["id"] for r in anchors.dedup_tolerance(rows, "v", ["id"], 999, rows_per_chunk=100).collect()}
    assert kept == {0, 1000} and not composed


def test_thinning_keeps_rows_without_value(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1.0), (4, 1.0004)], "id int, v double")
    got = {r["id"] for r in anchors.dedup_tolerance(df, "v", ["id"]).collect()}
    assert got == {1, 2, 3}


def by_key(frame, by, fn):
    ordered = frame.sort_values(["t", "id"])
    return fn(ordered) if not by else ordered.groupby("k", group_keys=False)[ordered.columns.tolist()].apply(fn)


def same(spark_df, want, col="v"):
    got = {r["id"]: r[col] for r in spark_df.collect()}
    assert len(got) == len(want)
    for i, v in zip(want["id"], want[col]):
        if pd.isna(v):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(v)


@pytest.mark.parametrize("chunk", [None, 9, 50])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_windows_match_pandas(spark, chunk, by):
    frame = readings(2, 200)
    df = to_spark(spark, frame)
    order = ["t", "id"]
    want = by_key(frame, by, lambda g: g.assign(v=g["v"].rolling(4, min_periods=1).mean()))
    same(windows.smooth(df, ["v"], order, 4, by, chunk), want)
    want = by_key(frame, by, lambda g: g.assign(v=g["v"].ffill()))
    same(windows.ffill(df, ["v"], order, by, chunk), want)
    want = by_key(frame, by, lambda g: g.assign(v=g["v"].interpolate("linear")))
    same(windows.interpolate(df, ["v"], order, by, chunk), want)


@pytest.mark.parametrize("chunk", [None, 5])
def test_unique_suffixes(spark, chunk):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)] + [(30, None)], "id int, v string")
    got = {r["id"]: r["v"] for r in windows.enforce_unique(df, "v", ["id"], chunk).collect()}
    seen, want = {}, {30: None}
    for i in range(30):
        v = "a" if i % 3 else "b"
        n = seen[v] = seen.get(v, -1) + 1
        want[i] = v if n == 0 else f"{v}_{n}"
    assert got == want


@pytest.mark.parametrize("window, chunk", [(2, 5), (30, 9), (100, 20), (500, 20), (1, 7)])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_rolling_means_over_many_chunks(spark, window, chunk, by):
    frame = readings(5, 150)
    want = by_key(frame, by, lambda g: g.assign(v=g["v"].rolling(window, min_periods=1).mean()))
    same(windows.smooth(to_spark(spark, frame), ["v"], ["t", "id"], window, by, chunk), want)


def test_a_chunk_gets_no_more_rows_than_its_window_reaches(spark):
    from brightrow.operators.ordered import CHUNK, split_by_order

    parts, chunks = split_by_order(spark.range(2_000).selectExpr("id", "double(id) AS v"), [], ["id"], 100)
    assert chunks == 20
    halo = windows._halo(parts, [], ["id"], 351)
    sizes = [r["count"] for r in halo.groupBy(CHUNK).count().collect()]
    assert len(sizes) == 19 and max(sizes) == 350
    plan = halo._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


@pytest.mark.parametrize("width", [5, 400])
def test_small_chunks_share_tasks(spark, monkeypatch, width):
    """The number of ranges, which are tasks, does not follow that of the chunks."""
    rows = spark.range(3_000).selectExpr("id", "double(id) AS v")
    made, by_range = [], type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda df, n, *c: made.append(n) or by_range(df, n, *c))
    kept = {r["id"] for r in anchors.dedup_tolerance(rows, "v", ["id"], width, rows_per_chunk=20).collect()}
    assert kept == set(range(0, 3_000, width + 1))
    filled = windows.ffill(rows.withColumn("v", F.expr("if(id % 1000 = 7, v, null)")), ["v"], ["id"], rows_per_chunk=20)
    for r in filled.collect():
        known = (r["id"] - 7) // 1000 * 1000 + 7
        assert r["v"] == (known if known > 0 else None)
    assert len(made) == 2 and max(made) <= 4


@pytest.mark.parametrize("window, chunk", [(100, None), (101, 40), (128, 7), (1_000, 60)])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_wide_rolling_means_are_sums_of_blocks(spark, window, chunk, by):
    """No frame of the window's width; infinite values and gaps reach as far as the window only."""
    frame = readings(8, 420)
    frame.loc[frame["t"].between(100, 350), "v"] = np.nan
    frame.loc[frame["id"] == 17, "v"] = np.inf
    rows = to_spark(spark, frame).withColumns({"n": F.col("t") % 11, "d": (F.col("t") / 7).cast("decimal(9,3)")})
    got = windows.smooth(rows.drop("d"), ["v", "n"], ["t", "id"], window, by, chunk)
    assert got.schema == windows.smooth(rows.drop("d"), ["v", "n"], ["t", "id"], 3, by, chunk).schema
    frame["n"] = frame["t"] % 11
    mean = lambda g, c: [np.mean([x for x in g[c].tolist()[max(0, i - window + 1) : i + 1] if x == x] or [np.nan]) for i in range(len(g))]
    for c in ("v", "n"):
        same(got, by_key(frame, by, lambda g: g.assign(**{c: mean(g, c)})), c)
    assert f"-{window - 1}, currentrow$()" not in got._jdf.queryExecution().optimizedPlan().toString()
    exact = windows.smooth(rows.select("id", "k", "t", "d"), ["d"], ["t", "id"], window, by, chunk)
    assert exact.schema["d"].dataType.simpleString() == "decimal(13,7)"


# Operators that split keys, on rows of 100 chunks.
SPLIT = {
    "suffixes": lambda rows, chunk: windows.enforce_unique(rows, "c", ["id"], chunk),
    "interpolate": lambda rows, chunk: windows.interpolate(rows, ["v"], ["id"], rows_per_chunk=chunk),
    "fill": lambda rows, chunk: windows.ffill(rows, ["v"], ["id"], ["c"], chunk),
    "means": lambda rows, chunk: windows.smooth(rows, ["v"], ["id"], 5, rows_per_chunk=chunk),
}


@pytest.mark.parametrize("name", list(SPLIT))
def test_tasks_do_not_follow_the_number_of_chunks(spark, monkeypatch, name):
    rows = spark.range(2_000).selectExpr("id", "concat('c', id % 3) AS c", "if(id % 7 < 3, double(id * id % 101), null) AS v")
    want = sorted(SPLIT[name](rows, None).collect(), key=repr)
    made, by_range = [], type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda df, n, *c: made.append(n) or by_range(df, n, *c))
    assert sorted(SPLIT[name](rows, 20).collect(), key=repr) == want
    assert made == [4]


def test_numbers_without_a_key_come_from_places(spark):
    """A row's place among the sorted ranges is its number: no window, no shuffle and no join beyond."""
    from brightrow.operators.ordered import numbered

    rows = spark.range(500).selectExpr("id", "if(id % 50 = 0, null, (id * 37) % 101) AS t")
    out, chunks = numbered(rows, [], ["t", "id"], "n", 20)
    assert chunks == 25
    want = sorted(((r["t"] is None, r["t"] or 0, r["id"]) for r in rows.collect()))
    assert [r["id"] for r in out.orderBy("n").collect()] == [i for *_, i in want]
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 501))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Exchange", "Join"))


@pytest.mark.parametrize("chunk", [None, 9])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_fill_carries_values_of_rows_without_time(spark, chunk, by):
    """Rows whose order value is missing come last, in what a chunk hands on as well."""
    frame = readings(11, 200)
    frame["t"] = frame["t"].astype(float).where(frame["t"] < 250)
    frame["v"] = frame["v"].where(frame["id"] % 5 == 0)
    rows = spark.createDataFrame(
        [tuple(None if pd.isna(x) else c(x) for c, x in zip((int, int, int, float), r)) for r in frame.itertuples(index=False)],
        "id long, k int, t int, v double",
    )
    want = by_key(frame, by, lambda g: g.assign(v=g["v"].ffill()))
    same(windows.ffill(rows, ["v"], ["t", "id"], by, chunk), want)


@pytest.mark.parametrize("chunk", [None, 7, 2])
def test_rolling_means_over_equal_times_follow_one_order(spark, chunk):
    """Where the order leaves ties open, all chunks and the rows copied into them go by the same one."""
    rows = spark.range(50).selectExpr("id", "0 AS t", "pow(2, id) AS v")
    means = {r["id"]: r["v"] for r in windows.smooth(rows, ["v"], ["t"], 3, rows_per_chunk=chunk).collect()}
    # The bits of a sum are the rows of its window.
    whole = {i: round(3 * m) for i, m in means.items() if round(3 * m).bit_count() == 3 and round(3 * m) >> i & 1}
    assert len(means) == 50 and len(whole) == 48
    assert sorted(sum(bits >> i & 1 for bits in whole.values()) for i in range(50)) == [1, 1, 2, 2] + [3] * 46
