"""Physical plans: what must and must not happen at scale."""

import io
from contextlib import contextmanager, redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from brightrow.operators import dedup, project, validate
from brightrow.suite import QUERIES


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@contextmanager
def recorded():
    """The plans of all jobs that a query starts by writing or by bringing rows to the driver."""
    plans: list[str] = []
    undo = []

    def watch(kind, name, frame):
        real = getattr(kind, name)
        undo.append((kind, name, real))

        def run(self, *args, **kwargs):
            plans.append(plan(frame(self)))
            return real(self, *args, **kwargs)

        setattr(kind, name, run)

    for name in ("parquet", "json", "csv", "orc", "save", "saveAsTable"):
        watch(DataFrameWriter, name, lambda w: w._df)
    for name in ("collect", "first", "count"):
        watch(DataFrame, name, lambda df: df)
    try:
        yield plans
    finally:
        for kind, name, real in undo:
            setattr(kind, name, real)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_and_no_row_functions(spark, folder, name):
    with recorded() as plans:
        plans.append(plan(QUERIES[name](spark, folder)))
    for text in plans:
        for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert forbidden not in text


def test_similarity_joins_are_equi_joins(spark, folder, monkeypatch):
    from brightrow.operators import similarity

    seen = []
    real = similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: seen.append(plan(df)) or real(df))
    QUERIES["dedup_cosine_documents"](spark, folder)
    QUERIES["dedup_similar_names"](spark, folder)
    assert seen and not any("NestedLoop" in p or "Cartesian" in p for p in seen)


def test_filter_and_columns_reach_the_scan(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    text = plan(project.select_where(orders, [("o_totalprice", ">", 1000.0)]).select("o_orderkey"))
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_keep_first_limits_before_the_shuffle(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = plan(dedup.dedup_first(lines, ["l_orderkey"], ["l_partkey", "l_suppkey"]))
    assert text.count("WindowGroupLimit") >= 2  # partial and final


def test_rules_take_one_scan(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    rules = {"o_totalprice": {"min": 1}, "o_orderstatus": {"allowed": ["O"]}, "o_orderpriority": {"pattern": "1"}}
    tree = plan(validate.validate(orders, rules)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 1


def test_top_rows_need_no_full_sort(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert "TakeOrderedAndProject" in plan(project.limit_rows(events, 5, ["ts", "event_id"]))
    keyset = project.page(events, ["event_id"], page_size=10, after=[100])
    assert "TakeOrderedAndProject" in plan(keyset) and "GreaterThan(event_id,100)" in plan(keyset)
    assert [r["event_id"] for r in keyset.collect()] == list(range(101, 111))
    deep = project.page(events, ["ts", "event_id"], 40, 10, rows_per_chunk=100)
    assert "Offset" not in plan(deep) and "offset" not in plan(deep)


def test_wide_paths_need_no_shuffle(spark, folder):
    assert "Exchange" not in plan(QUERIES["widen_paths"](spark, folder)).split("\n\n")[0]


def test_foreign_keys_are_counted_before_the_join(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").where(F.col("o_orderstatus") == "O")
    tree = plan(validate.fk_violations(lines, {"l_orderkey": (orders, "o_orderkey")})).split("\n\n")[0]
    below = tree[tree.index("LeftOuter") :]
    assert below.index("HashAggregate") < below.index("lineitem" if "lineitem" in below else "Scan parquet")
