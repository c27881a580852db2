"""Column and table operators on small samples with nulls and odd values."""

import datetime
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brightrow.functions import text
from brightrow.operators import dedup, nested, nulls, ordered, project, scaling, strings, timeseries
from brightrow.plans import cleaning


def column(df, name):
    return [r[name] for r in df.collect()]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_strip_takes_all_unicode_spaces(spark):
    assert one(spark, "  \t a b \n", text.strip) == "a b"
    assert one(spark, "a  \n b", text.squeeze) == "a b"
    assert one(spark, None, text.strip) is None


def test_special_characters_are_ascii_only(spark):
    assert one(spark, "Crème-brûlée #1!", text.strip_special) == "Crmebrle 1"


def test_strip_affixes_once(spark):
    assert one(spark, "ababx--", lambda c: text.strip_affixes(c, "ab", "-")) == "abx-"


@pytest.mark.parametrize(
    "value, seconds",
    [("00:03:45", 225.0), ("3:45", 225.0), ("225", 225.0), ("1:2:3:4", None), ("a:b", None), ("1.5", 1.5), (None, None)],
)
def test_durations(spark, value, seconds):
    assert one(spark, value, text.duration_seconds) == seconds


def test_numbers_as_text(spark):
    for value, number in [(" 1e3 ", 1000.0), ("-.5", -0.5), ("1d", None), ("", None), ("0x1", None), ("5.", 5.0)]:
        assert one(spark, value, text.to_number) == number


def test_auto_cast_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1", "", "x"), ("", "2.5", "", "1"), (None, "3", None, "2")], "a string, b string, c string, d string")
    out = strings.auto_cast(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "double", "string", "string"]
    assert column(out, "a") == [1, None, None]


def test_dates_by_layout(spark):
    values = ["2024-01-02", "2024/01/02", "01/02/2024", "02-01-2024", "20240102", "2024-01-02T03:04:05", "soon", None]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = column(strings.parse_dates(df, ["d"]), "d")
    assert got[:5] == [datetime.datetime(2024, 1, 2)] * 5
    assert got[5:] == [datetime.datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_typed_fill_leaves_other_types(spark):
    df = spark.createDataFrame([(None, None), ("a", math.nan)], "s string, n double")
    assert column(nulls.fill(df), "n")[0] is None
    assert column(nulls.fill(df, 0), "n") == [0.0, 0.0]
    assert column(nulls.fill(df), "s") == ["", "a"]


def test_drop_missing_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "b"), (None, None)], "n double, s string")
    assert nulls.drop_missing(df).count() == 1
    assert nulls.drop_missing(df, thresh=1).count() == 2
    assert nulls.drop_missing(df, axis="columns", thresh=2).columns == ["s"]
    assert nulls.drop_empty_rows(df).count() == 2


def test_replace_is_simultaneous(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    out = nulls.replace(df, {"a": "b", "b": "c", 1: 2, 2: 3})
    assert [tuple(r) for r in out.collect()] == [("b", 2), ("c", 3)]


def test_large_mapping_is_joined(spark):
    df = spark.createDataFrame([("k1",), ("other",), (None,)], "s string")
    out = nulls.map_values(df, "s", {f"k{i}": f"v{i}" for i in range(nulls.MAP_LITERAL_LIMIT + 1)})
    assert sorted(map(str, column(out, "s"))) == ["None", "other", "v1"]


@pytest.mark.parametrize("kind", ["double", "string", "bigint", "decimal(10,2)"])
def test_mapping_is_typed_alike_at_any_size(spark, kind):
    df = spark.createDataFrame([("1",), ("2",), ("7",), (None,)], "s string").select(F.col("s").cast(kind).alias("c"))
    small = {1: 10, 2: Decimal("20.50") if kind in ("string", "decimal(10,2)") else 20, None: 5}
    large = small | {i: 2 * i for i in range(1000, 1600)}
    results = [sorted(map(str, column(nulls.map_values(df, "c", m), "c"))) for m in (small, large)]
    assert results[0] == results[1] and len(set(results[0])) == 4


def test_one_hot_limit(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        nulls.categories(df, "c", limit=5)
    assert len(nulls.one_hot(df, ["c"]).columns) == 19


def test_zero_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (1, 0)], "a int, b int")
    assert project.remove_zero_rows(df).count() == 2


def test_names_that_collide(spark):
    df = spark.createDataFrame([(1, 2)], "`A ` int, b int")
    assert project.normalize_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        project.normalize_names(spark.createDataFrame([(1, 2)], "`a ` int, `a` int"))


def test_outliers_of_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert scaling.remove_outliers(df).count() == 3
    assert scaling.remove_outliers(df, strict=True).count() == 0
    assert column(scaling.flag_outliers(df, "b"), "outlier_b") == [False] * 3
    assert scaling.count_anomalies(df, "b").first()["anomalies"] == 0


def test_outliers_in_sequence_differ_from_joint(spark):
    rows = [(float(i % 5), float(i % 7)) for i in range(50)] + [(1000.0, 1000.0), (2.0, 30.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert scaling.remove_outliers(df).count() < scaling.remove_outliers(df, mode="joint").count()


def test_record_outliers(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple([1.0] * 11 + [500.0])], ", ".join(f"{n} double" for n in names))
    out = scaling.null_record_outliers(df).first()
    assert out["c11"] is None and out["c0"] == 1.0


def test_summary_sentence(spark):
    df = spark.createDataFrame([("2023-01-01", 100), ("2023-01-02", 120)], "date string, sales bigint")
    assert scaling.summary_sentence(df) == (
        "The query returned 2 rows and 2 columns. Sample columns are: date (string), sales (bigint)."
        " For 'sales', the mean is 110.00."
    )
    assert scaling.summary_sentence(df.where("false"), "fr_FR") == "Aucun résultat trouvé."


def test_trend(spark):
    rows = [(datetime.date(2023, 1, d + 1), v) for d, v in enumerate([100, 120, 130, 150, 170])]
    row = scaling.detect_trend(spark.createDataFrame(rows, "date date, sales int"), "date", "sales").first()
    assert (row["slope"], row["trend"]) == (14.0, scaling.TREND_UP)


def test_resample_splits_long_grids(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "GRID_BLOCK", 3)
    rows = [("2024-01-01 10:00:00", 1.0), ("2024-01-01 10:07:30", 3.0), ("2024-01-01 10:07:10", 5.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.to_timestamp("t"))
    out = timeseries.resample_mean(df, "t", "1min").orderBy("t").collect()
    assert [r["v"] for r in out] == [1.0] + [None] * 6 + [4.0]
    with pytest.raises(ValueError):
        timeseries.bin_micros("0min")


def test_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    assert sorted(column(dedup.dedup_first(df, ["k"], ["id"]), "id")) == [1, 3]
    assert sorted(column(dedup.dedup_last(df, ["k"], ["id"]), "id")) == [2, 3]
    assert dedup.count_duplicates(df, ["k"]).first()["duplicates"] == 1


def test_json_sample(spark):
    rows = [(1, " Alice ", "Active", "100"), (2, "Bob", None, "200"), (2, "Bob", None, "200"), (3, None, "x!", None)]
    df = spark.createDataFrame(rows, "id long, name string, status string, score string")
    out = cleaning.clean(df, "json").data.orderBy("id")
    assert out.schema["score"].dataType.simpleString() == "bigint"
    assert column(out, "status") == ["ACTIVE", ""]  # the row without a score has no z-score
    assert column(out, "name") == ["alice", "bob"]


def test_sensor_sample(spark):
    rows = [
        ("2025-01-01 10:00:00", 20.0, 40.0),
        ("2025-01-01 10:01:00", 21.0, None),
        ("2025-01-01 10:03:00", 23.0, 43.0),
        ("2025-01-01 10:03:00", 25.0, 45.0),
    ]
    df = spark.createDataFrame(rows, "timestamp string, temperature double, humidity double")
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    out = cleaning.clean(df, "sensor", ts_col="timestamp").data
    assert [round(x, 6) for x in column(out, "temperature")] == [20.0, 20.5, 21.166667, 22.5]
    assert len(column(out, "humidity")) == 4


def test_video_sample_keeps_colons(spark):
    rows = [("a.mp4", "h264", "1920x1080", "00:02:30", "30"), ("b.mp4", "h264", "1280X720", "105", None)]
    df = spark.createDataFrame(rows, "filename string, codec string, resolution string, duration string, frame_rate string")
    out = cleaning.clean(df, "video", z=100.0, order_by=["filename"]).data
    assert sorted(column(out, "duration")) == [127.5, 150.0]  # 150, then the mean of 150 and 105


def test_yaml_sample(spark):
    doc = '{"sensor": {"id": " s1 ", "status": "ok"}, "metrics": {"temperature": "22", "humidity": null}, "tags": ["a", "a"]}'
    out = cleaning.clean_documents(spark.createDataFrame([(1, doc)], "k int, doc string"), "k", "doc").data.first()
    assert out["sensor.id"] == "S1" and out["metrics.temperature"] == 22
    assert out["tags[0]"] == out["tags[1]"] == "A"


def test_failing_stage_is_reported(spark):
    df = spark.createDataFrame([("a",)], "s string")
    done = cleaning.clean_table(df, "json", strategy="no such")
    assert [e["step"] for e in done.errors] == ["deduplication"]
    assert done.data.count() == 1
    assert cleaning.clean_table(df, "no such").errors[0]["step"] == "format"


def test_null_entry_of_any_map(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "c string")
    mapping = {None: "missing", "a": "A"}
    large = mapping | {f"unused{i}": "x" for i in range(600)}
    for chosen in (mapping, large):
        assert sorted(r["c"] for r in nulls.map_values(df, "c", chosen).collect()) == ["A", "b", "missing"]


def test_long_whole_numbers_stay_exact(spark):
    rows = [("1234567890123456789", "99999999999999999999", "1.5"), ("1234567890123456788", "7", "99999999999999999999")]
    out = strings.auto_cast(spark.createDataFrame(rows, "a string, b string, c string"))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "decimal(38,0)", "double"]
    assert {r["a"] for r in out.collect()} == {1234567890123456789, 1234567890123456788}
    assert {int(r["b"]) for r in out.collect()} == {99999999999999999999, 7}


def test_last_child_at_every_depth(spark):
    df = spark.createDataFrame([(([1, 2], [(["x", "y"],), (["z", "w"],)]),), (None,)], "m struct<t:array<int>,n:array<struct<k:array<string>>>>")
    out = nested.last_repeated(df)
    assert out.schema["m"].dataType.simpleString() == "struct<t:int,n:struct<k:string>>"
    assert sorted(out.selectExpr("m.t", "m.n.k").collect(), key=str) == [(2, "w"), (None, None)]


def test_one_key_of_an_exploded_input_splits(spark):
    """Rows are counted, not estimated: one row that explodes is no small input."""
    many = spark.range(1).selectExpr("explode(sequence(1, 5000)) AS i").withColumn("v", F.col("i").cast("double"))
    parts, chunks = ordered.split_by_order(many, [], ["i"], rows_per_chunk=1000)
    assert chunks == 5 and parts.select("__chunk").distinct().count() > 1
