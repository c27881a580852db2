"""Validation, integrity and layout queries."""

import datetime

from pyspark.sql import functions as F

from brightrow.operators import validate
from brightrow.sources import layout
from brightrow.suite.registry import query, scratch, table
from brightrow.suite.strings import NULLED_EVENTS, nulled_events


@query(
    "count_missing_values",
    "SELECT 'event_type' AS column, count(*) - count(event_type) AS missing_count FROM"
    f" ({NULLED_EVENTS}) UNION ALL SELECT 'value', count(*) - count(value) FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    return validate.check_missing(nulled_events(spark, d), ["event_type", "value"])


@query(
    "rows_with_missing_values",
    f"SELECT event_id, 'event_type' AS column FROM ({NULLED_EVENTS}) WHERE event_type IS NULL UNION ALL"
    f" SELECT event_id, 'value' FROM ({NULLED_EVENTS}) WHERE value IS NULL",
)
def _(spark, d):
    return validate.missing_rows(nulled_events(spark, d), ["event_type", "value"], ["event_id"])


def _verdict(col: str, rule: str, bad: str, source: str) -> str:
    return (
        f"SELECT '{col}' AS column, '{rule}' AS rule, count(*) FILTER ({bad}) AS invalid_count,"
        f" CASE WHEN count(*) FILTER ({bad}) > 0 THEN 'fail' ELSE 'pass' END AS status FROM {source}"
    )


@query("check_numeric_range", _verdict("value", "range", "value < 1 OR value > 150", f"({NULLED_EVENTS})"))
def _(spark, d):
    return validate.check_range(nulled_events(spark, d), "value", 1, 150)


@query(
    "check_pattern",
    _verdict("event_type", "pattern", "NOT coalesce(regexp_matches(event_type, '^(?:[cv])'), false)", f"({NULLED_EVENTS})"),
)
def _(spark, d):
    return validate.check_regex(nulled_events(spark, d), "event_type", "[cv]")


@query(
    "check_allowed_values",
    _verdict("event_type", "allowed", "NOT coalesce(event_type IN ('click', 'view'), false)", f"({NULLED_EVENTS})"),
)
def _(spark, d):
    return validate.check_allowed(nulled_events(spark, d), "event_type", ["click", "view"])


_RULES = {
    "o_totalprice": {"min": 1000, "max": 400000},
    "o_orderpriority": {"pattern": r"[1-4]-[A-Z ]+$"},
    "o_orderstatus": {"allowed": ["O", "F"]},
    "o_comment": {"pattern": "x"},
}


@query(
    "validate_rules",
    _verdict("o_totalprice", "range", "o_totalprice < 1000 OR o_totalprice > 400000", "orders")
    + " UNION ALL "
    + _verdict("o_orderpriority", "pattern", "NOT regexp_matches(o_orderpriority, '^(?:[1-4]-[A-Z ]+$)')", "orders")
    + " UNION ALL "
    + _verdict("o_orderstatus", "allowed", "o_orderstatus NOT IN ('O', 'F')", "orders")
    + " UNION ALL "
    + _verdict("o_comment", "pattern", "false", "orders"),
)
def _(spark, d):
    return validate.validate(table(spark, d, "orders"), _RULES)


@query(
    "rule_violations",
    "SELECT o_orderkey, 'o_totalprice' AS column, 'range' AS rule, CAST(o_totalprice AS VARCHAR) AS value FROM orders"
    " WHERE o_totalprice < 1000 OR o_totalprice > 400000"
    " UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern', o_orderpriority FROM orders"
    " WHERE NOT regexp_matches(o_orderpriority, '^(?:[1-4]-[A-Z ]+$)')"
    " UNION ALL SELECT o_orderkey, 'o_orderstatus', 'allowed', o_orderstatus FROM orders"
    " WHERE o_orderstatus NOT IN ('O', 'F')",
)
def _(spark, d):
    return validate.violations(table(spark, d, "orders"), _RULES, ["o_orderkey"])


_LABELLED = "documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query(
    "check_reference_values",
    "SELECT 'doc_id' AS column, count(*) AS invalid_count, 'fail' AS status FROM"
    " (SELECT CASE WHEN doc_id % 10 <> 0 THEN doc_id END AS doc_id FROM documents) d"
    " WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, d):
    key = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id"))
    rows = table(spark, d, "documents").select(key.alias("doc_id"))
    return validate.check_fk(rows, "doc_id", table(spark, d, "labels"), "doc_id")


@query(
    "rows_outside_reference",
    f"SELECT d.doc_id, d.lang FROM {_LABELLED} WHERE l.doc_id IS NULL",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return validate.fk_rows(rows, "doc_id", table(spark, d, "labels"), "doc_id")


_OPEN = "(SELECT * FROM orders WHERE o_orderstatus = 'O')"


@query(
    "orphaned_foreign_keys",
    "SELECT 'l_orderkey' AS column, count(*) AS violations FROM lineitem LEFT JOIN"
    f" {_OPEN} o ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL"
    " UNION ALL SELECT 'l_suppkey', count(*) FROM"
    " (SELECT CASE WHEN l_linenumber <> 1 THEN l_suppkey END AS l_suppkey FROM lineitem) l LEFT JOIN"
    " (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON l_suppkey = s_suppkey"
    " WHERE s_suppkey IS NULL AND l_suppkey IS NOT NULL",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")).alias("l_suppkey")
    )
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'")
    suppliers = table(spark, d, "supplier").where("s_acctbal > 5000")
    return validate.fk_violations(
        lines, {"l_orderkey": (orders, "o_orderkey"), "l_suppkey": (suppliers, "s_suppkey")}
    )


@query(
    "table_report",
    "SELECT 'missing' AS \"check\", 'event_type' AS subject, count(*) - count(event_type) AS \"count\" FROM"
    f" ({NULLED_EVENTS}) UNION ALL SELECT 'missing', 'value', count(*) - count(value) FROM ({NULLED_EVENTS})"
    f" UNION ALL SELECT 'duplicates', 'user_id,event_type', count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id,"
    f" event_type FROM ({NULLED_EVENTS}))) FROM ({NULLED_EVENTS})"
    " UNION ALL SELECT 'foreign_key', 'user_id', count(*) FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation)",
)
def _(spark, d):
    return validate.table_report(
        nulled_events(spark, d),
        ["event_type", "value"],
        {"user_id": (table(spark, d, "nation"), "n_nationkey")},
        ["user_id", "event_type"],
    )


@query(
    "schema_drift_of_files",
    "SELECT * FROM (VALUES ('c_acctbal', 'double', 'int', 1::BIGINT), ('c_mktsegment', 'string', NULL, 1::BIGINT))"
    ' v("column", expected, actual, files)',
)
def _(spark, d):
    path = scratch(spark, "drift")
    customer = table(spark, d, "customer")
    customer.coalesce(1).write.parquet(f"{path}/day=1")
    customer.selectExpr("c_custkey", "int(c_acctbal) c_acctbal", "c_name", "c_nationkey").coalesce(1).write.parquet(
        f"{path}/day=2"
    )
    return validate.schema_drift(spark, path, customer.schema)


@query(
    "partition_orders_by_date",
    """
    WITH p AS (SELECT o_orderkey, o_orderdate, DATE '1996-01-01' + 30 * CAST(floor(date_diff('day', DATE '1996-01-01',
               o_orderdate::DATE) / 30) AS INT) AS s,
               date_diff('day', DATE '1996-01-01', o_orderdate::DATE) AS off FROM orders)
    SELECT o_orderkey, o_orderdate, CASE WHEN off >= 0 AND off < ceil(date_diff('day', DATE '1996-01-01',
           DATE '1998-06-15') / 30) * 30
           THEN concat('orders_', strftime(s, '%Y%m%d'), '_', strftime(s + 30, '%Y%m%d')) ELSE '__other__' END
           AS partition_name
    FROM p
    """,
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    start, end = datetime.date(1996, 1, 1), datetime.date(1998, 6, 15)
    return layout.partition_by_date(rows, "orders", "o_orderdate", start, end, 30, unmatched="other")


@query(
    "partition_customers_by_hash",
    "SELECT c_mktsegment, count(*) AS n, 1::BIGINT AS labels, true AS well_named FROM customer GROUP BY c_mktsegment",
)
def _(spark, d):
    """Rows of one key value share one label, which names its remainder."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    labelled = layout.partition_by_hash(rows, "customer", "c_mktsegment", 8)
    return labelled.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(layout.PARTITION).alias("labels"),
        F.bool_and(F.col(layout.PARTITION).rlike("^customer_hash_[0-7]$")).alias("well_named"),
    )


@query(
    "partition_parts_by_range",
    "SELECT p_partkey, p_size, CASE WHEN p_size >= 0 AND p_size < 10 THEN 'part_0_10' WHEN p_size >= 10 AND p_size < 30"
    " THEN 'part_10_30' ELSE '__other__' END AS partition_name FROM part",
)
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    ranges = [{"start": 0, "end": 10}, {"start": 10, "end": 30}]
    return layout.partition_by_range(rows, "part", "p_size", ranges, unmatched="other")


@query(
    "partitioned_write_counts",
    "SELECT CASE WHEN p_size < 10 THEN 'part_0_10' WHEN p_size < 30 THEN 'part_10_30' ELSE 'part_30_99' END"
    " AS partition_name, count(*) AS n FROM part GROUP BY 1",
)
def _(spark, d):
    config = [
        {
            "table_name": "part",
            "partition_type": "range",
            "column": "p_size",
            "ranges": [{"start": 0, "end": 10}, {"start": 10, "end": 30}, {"start": 30, "end": 99}],
        }
    ]
    path = scratch(spark, "parts")
    labelled = layout.partition_tables({"part": table(spark, d, "part")}, config)["part"]
    layout.write_partitioned(labelled, path)
    return spark.read.parquet(path).groupBy("partition_name").agg(F.count(F.lit(1)).alias("n"))


def _partitioned_lines(spark, d) -> str:
    path = scratch(spark, "lines")
    layout.write_partitioned(layout.partition_by_hash(table(spark, d, "lineitem"), "lineitem", "l_partkey"), path)
    return path


_FOUR_PARTS = "SELECT concat('lineitem_hash_', i) AS partition_name, true AS {} FROM range(4) r(i)"


@query("partition_sizes", _FOUR_PARTS.format("filled"))
def _(spark, d):
    sizes = layout.partition_sizes(spark, _partitioned_lines(spark, d))
    return sizes.select("partition_name", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("filled"))


@query("large_partitions", _FOUR_PARTS.format("large"))
def _(spark, d):
    large = layout.large_partitions(spark, _partitioned_lines(spark, d), limit_mb=0.001)
    return large.select("partition_name", (F.col("size_mb") > 0.001).alias("large"))
