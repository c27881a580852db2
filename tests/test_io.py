"""Readers, writers, layouts and streams over temporary files."""

import datetime

import pytest
from pyspark.sql import functions as F

from brightrow.operators import validate
from brightrow.sources import ingest, layout, readers, sinks
from brightrow.streaming import messages


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a,b"), (2, 'q"x'), (3, None)], "id int, name string")


def test_csv_types_and_errors(spark, people, tmp_path):
    path = str(tmp_path / "x.csv")
    sinks.export_files(people, path, "csv")
    out = readers.read_csv(spark, path)
    assert out.schema["id"].dataType.simpleString() == "int"
    assert {r["name"] for r in out.collect()} == {"a,b", 'q"x', None}
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, path, {"age": "int"})
    with pytest.raises(ValueError, match="cast"):
        readers.read_csv(spark, path, {"name": "int"})
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        sinks.export_files(people, path, "xlsx")


def test_json_document_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": {"b": 1}},\n {"a": {"b": 2}}]')
    out = readers.read_json(spark, str(tmp_path / "a.json"), sep="_", lines=False)
    assert [r["a_b"] for r in out.collect()] == [1, 2]


def test_xml_with_namespace_attributes_and_repeats(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<x:all xmlns:x="urn:x"><x:rec k="1"><x:name>A</x:name><x:name>B</x:name><x:at u="m">5</x:at></x:rec></x:all>'
    )
    row = readers.read_xml(spark, str(tmp_path / "a.xml"), "rec", sep="_").first().asDict()
    assert row["@k"] == 1 and row["name"] == "B" and row["at_@u"] == "m" and row["at"] == 5


def test_log_kinds(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2024-01-01 10:00:00 web nginx: started\n\nJan  5 10:00:00 db cron-d: tick tock\n  garbage \n"
    )
    path = str(tmp_path / "a.log")
    assert [r["process"] for r in readers.read_logs(spark, path, "syslog").collect()] == ["nginx"]
    kept = readers.read_logs(spark, path, "syslog", keep_unmatched=True).collect()
    assert sorted((r["service"] or "", r["line"] or "") for r in kept) == [
        ("", "2024-01-01 10:00:00 web nginx: started"),
        ("", "garbage"),
        ("cron-d", ""),
    ]
    assert readers.read_logs(spark, path).count() == 3
    with pytest.raises(ValueError):
        readers.read_logs(spark, path, "binary")


def test_yaml_documents(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("sensor: {id: s1}\ntags: [a, b]\nwhen: 2024-01-02\n")
    (tmp_path / "b.yaml").write_text("- sensor: {id: s2}\n- sensor: {id: s3}\n")
    out = readers.read_yaml(spark, str(tmp_path), ["sensor"])
    assert sorted(r["sensor.id"] for r in out.collect()) == ["s1", "s2", "s3"]
    with pytest.raises(ValueError):
        readers.read_yaml(spark, str(tmp_path), ["tags"])


def test_avro_without_its_package_says_so(spark, tmp_path):
    with pytest.raises(RuntimeError, match="spark-avro"):
        readers.read_avro(spark, str(tmp_path))


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", "select 1")
    assert plain == {"url": "jdbc:x", "fetchsize": "1000", "query": "select 1"}
    sliced = readers.jdbc_options("jdbc:x", "select 1 k", partition_column="k", lower=0, upper=9, partitions=3)
    assert sliced["dbtable"] == "(select 1 k) q" and sliced["numPartitions"] == "3"
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "select 1", partition_column="k")


def test_jdbc_disposition_is_checked(people):
    with pytest.raises(ValueError):
        sinks.write_jdbc(people, "jdbc:x", "t", "WRITE_MAYBE")


def test_upsert_last_update_wins(spark, people):
    updates = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (9, "add", 1)], "id int, name string, at int")
    out = {r["id"]: r["name"] for r in sinks.upsert(people, updates, ["id"], ["at"]).collect()}
    assert out == {1: "a,b", 2: "new", 3: None, 9: "add"}


def test_sensor_rows(spark):
    rows = [("2024-01-02", 1.0), ("soon", 2.0), ("2024-01-01", 3.0), ("2024-01-01", 3.0)]
    df = spark.createDataFrame(rows, "timestamp string, v double")
    with pytest.warns(UserWarning):
        out = readers.normalize_sensor(df, expected=["humidity"])
    assert [r["v"] for r in out.collect()] == [3.0, 1.0]


def test_ingest_reports_each_file(spark, people, tmp_path):
    good, bad = str(tmp_path / "good.csv"), str(tmp_path / "bad.parquet")
    sinks.export_files(people, good, "csv")
    (tmp_path / "bad.parquet").write_text("not parquet")
    found = ingest.ingest_files(spark, [good, bad, str(tmp_path / "x.exe")], str(tmp_path / "staged"))
    staged = {r["source"].rsplit("/", 1)[1]: r["staged"] for r in found.collect()}
    assert {r["source"].rsplit("/", 1)[1]: r["status"] for r in found.collect()} == {
        "good.csv": "staged",
        "bad.parquet": "failed",
        "x.exe": "failed",
    }
    assert staged["good.csv"].startswith(str(tmp_path / "staged")) and staged["bad.parquet"] is None
    assert spark.read.parquet(staged["good.csv"]).count() == 3


def test_date_partitions(spark, tmp_path):
    start, end = datetime.date(2024, 1, 1), datetime.date(2024, 1, 10)
    assert layout.date_partition_names("t", start, end) == ["t_20240101_20240108", "t_20240108_20240115"]
    days = [datetime.date(2024, 1, d) for d in (1, 7, 8, 14)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    labelled = layout.partition_by_date(df, "t", "d", start, end)
    assert [r[layout.PARTITION] for r in labelled.collect()] == ["t_20240101_20240108"] * 2 + ["t_20240108_20240115"] * 2
    outside = spark.createDataFrame([(datetime.date(2024, 1, 15),)], "d date")
    assert layout.partition_by_date(outside, "t", "d", start, end, unmatched="other").first()[1] == layout.OTHER
    with pytest.raises(Exception, match="no partition"):
        layout.partition_by_date(outside, "t", "d", start, end).collect()
    layout.write_partitioned(labelled, str(tmp_path / "t"))
    sizes = layout.partition_sizes(spark, str(tmp_path / "t")).collect()
    assert len(sizes) == 2 and all(r["bytes"] > 0 for r in sizes)
    assert layout.large_partitions(spark, str(tmp_path / "t"), limit_mb=1).count() == 0
    pruned = spark.read.parquet(str(tmp_path / "t")).where(F.col(layout.PARTITION) == "t_20240101_20240108")
    assert len(pruned.inputFiles()) >= 1 and pruned.count() == 2


def test_unknown_partition_type(spark, people):
    with pytest.raises(ValueError):
        layout.partition_tables({"p": people}, [{"table_name": "p", "partition_type": "list", "column": "id"}])


def test_schema_drift(spark, people, tmp_path):
    path = str(tmp_path / "d")
    people.coalesce(1).write.parquet(f"{path}/day=1")
    people.selectExpr("bigint(id) id", "1.5 extra").coalesce(1).write.parquet(f"{path}/day=2")
    got = {(r["column"], r["expected"], r["actual"], r["files"]) for r in validate.schema_drift(spark, path, people.schema).collect()}
    assert got == {("id", "int", "bigint", 1), ("extra", None, "decimal(2,1)", 1), ("name", "string", None, 1)}


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    landing, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "cp"), []

    def collect(batch, batch_id):
        seen.extend(r["topic"] for r in batch.collect())

    for name in ("a", "b"):
        spark.createDataFrame([(name,)], "topic string").write.mode("append").json(landing)
        messages.run_batches(
            messages.landed_messages(spark, landing), collect, checkpoint, available_now=True
        ).awaitTermination(120)
    assert seen == ["a", "b"]


def test_kafka_shape(spark):
    raw = spark.createDataFrame(
        [(bytearray(b"k"), None, "t", 0, 5, datetime.datetime(2024, 1, 1))],
        "key binary, value binary, topic string, partition int, offset long, timestamp timestamp",
    )
    out = messages.kafka_shape(raw)
    assert [f.name for f in out.schema] == ["topic", "partition", "offset", "key", "value", "timestamp"]
    assert tuple(out.first())[:5] == ("t", 0, 5, "k", None)


def test_bounded_reads_go_on_and_count_messages(spark, tmp_path):
    from brightrow.streaming import messages

    rows = [(f"t{i}", str(i)) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "topic string, payload string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    seen = []
    reads = {0: lambda b: None, 1: lambda b: seen.extend(b.collect()), 2: lambda b: (b.count(), seen.extend(b.collect()))}
    stream = messages.landed_messages(spark, f"{tmp_path}/in", "topic string, payload string", max_files=1)
    for times, read in reads.items():
        # The count does not depend on how often the callback reads a batch.
        assert messages.drain(stream, lambda b, i, read=read: read(b), f"{tmp_path}/all{times}") == 30
    seen.clear()
    taken = [messages.drain(stream, lambda b, i: seen.extend(b.collect()), f"{tmp_path}/cp", n) for n in (12, 7, 1000)]
    assert taken == [12, 7, 11]
    assert sorted((r["topic"], r["payload"]) for r in seen) == sorted(rows)


def test_upsert_of_partitions(spark, tmp_path):
    """Moved keys, new partitions, null partitions, and one that loses its last row."""
    path = str(tmp_path / "t")
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None), (5, "e", "z")]
    spark.createDataFrame(rows, "k int, v string, p string").write.partitionBy("p").parquet(path)
    untouched = {f.name for f in (tmp_path / "t" / "p=z").iterdir()}
    updates = [(3, "moved", "x", 1), (4, "null", None, 1), (4, "later", None, 2), (9, "new", "w", 1)]
    df = spark.createDataFrame(updates, "k int, v string, p string, at int")
    sinks.upsert_table(spark, path, df, ["k"], ["at"], ["p"])
    got = {tuple(r) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "a", "x"), (2, "b", "x"), (3, "moved", "x"), (4, "later", None), (5, "e", "z"), (9, "new", "w")}
    assert {f.name for f in (tmp_path / "t" / "p=z").iterdir()} == untouched


def test_many_files_are_checked_in_one_job(spark, tmp_path):
    files = []
    for i in range(200):
        files.append(str(tmp_path / f"f{i}.csv"))
        (tmp_path / f"f{i}.csv").write_text("id,name\n" + (f"{i},ok\n" if i != 57 else ",bad\n,bad\n"))
    files.append(str(tmp_path / "f.unknown"))
    spark.sparkContext.setJobGroup("many", "files")
    found = ingest.ingest_checked_files(spark, files, str(tmp_path / "staged"), F.count_if(F.col("id").isNull()) == 0)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many")
    rows = found.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Listing, header, types, the check and the write; their number does not grow with the files.
    assert len(jobs) <= 8
    by = {r["source"]: r for r in rows}
    assert len(by) == 201 and by[files[57]]["status"] == "rejected" and by[files[200]]["status"] == "failed"
    assert sum(r["status"] == "staged" for r in rows) == 199
    staged = {r["staged"] for r in rows if r["staged"]}
    assert len(staged) == 1 and spark.read.parquet(*staged).count() == 199


@pytest.mark.parametrize(
    "text",
    ["", "~", "a: 1", "[]", "- 1", "- {a: [1, 2]}\n- b\n-\n", "- &x {a: 1}\n- *x\n- {<<: *x, b: 2}\n- [*x, *x]\n",
     "--- [1, {a: 2024-01-02}]\n...\n", "!!omap [a: 1, b: 2]", "&l [1, 2]", "!!seq [1]", "- |\n  ---\n  - no\n- >\n  end\n"],
)
def test_yaml_items_are_those_of_the_whole_text(text):
    import yaml

    whole = yaml.safe_load(text)
    assert list(readers.yaml_items(text)) == (whole if isinstance(whole, list) else [whole])


def test_yaml_list_is_read_item_by_item():
    """Memory follows the text, not the objects of all its items."""
    import itertools
    import tracemalloc

    import yaml

    text = "- {id: 1, info: {segment: A, balance: 1.5}}\n" * 3_000
    tracemalloc.start()
    try:
        assert sum(1 for _ in readers.yaml_items(text)) == 3_000
        assert tracemalloc.get_traced_memory()[1] < 2_000_000
    finally:
        tracemalloc.stop()
    broken = readers.yaml_items("- 1\n- 2\n--- 3\n")
    assert list(itertools.islice(broken, 2)) == [1, 2]
    with pytest.raises(yaml.YAMLError):
        next(broken)
