"""Projections, predicates, order, limits, pages, joins and counts."""

from pyspark.sql import functions as F

from brightrow.operators import dedup, project
from brightrow.sources import readers
from brightrow.suite.registry import query, rounded, table


@query(
    "rename_columns",
    "SELECT s_suppkey AS id, s_name AS name, s_nationkey, s_acctbal FROM supplier",
)
def _(spark, d):
    return project.rename(table(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "name", "absent": "x"})


@query("drop_columns", "SELECT p_partkey, p_name, p_brand FROM part")
def _(spark, d):
    return project.drop_columns(table(spark, d, "part"), ["p_type", "p_size", "p_retailprice", "absent"])


@query(
    "add_required_columns",
    "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS area, CAST(NULL AS VARCHAR) AS code FROM region",
)
def _(spark, d):
    return project.require_columns(table(spark, d, "region"), {"r_name": "string", "area": "double", "code": "string"})


@query("normalize_column_names", 'SELECT n_nationkey AS "nation key", n_name AS name FROM nation')
def _(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias(" Nation KEY "), F.col("n_name").alias("NAME"))
    return project.normalize_names(rows)


@query(
    "remove_zero_rows",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax FROM lineitem"
    " WHERE NOT (l_discount = 0 AND l_tax = 0)",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"
    )
    return project.remove_zero_rows(rows, ["l_discount", "l_tax"])


@query(
    "drop_matching_messages",
    "SELECT event_id, event_type FROM events WHERE NOT regexp_matches(event_type, 'error|clic.')",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return project.remove_matching(rows, ["error", "clic."], "event_type")


@query(
    "extract_fields",
    "SELECT event_id, nullif(regexp_extract(props, '\"k\": (\\d+)', 1), '') AS k,"
    " nullif(regexp_extract(props, '\"none\": (\\d+)', 1), '') AS none FROM events",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "props")
    patterns = {"k": r'"k": (?P<number>\d+)', "none": r'"none": (\d+)'}
    return project.extract_fields(rows, patterns, "props").drop("props")


@query("sort_by_balance", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def _(spark, d):
    return project.sort_by(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", False)


@query("first_rows", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 25")
def _(spark, d):
    return project.limit_rows(table(spark, d, "events").select("event_id", "ts", "value"), 25, ["ts", "event_id"])


@query(
    "third_page",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 200",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return project.page(rows, ["o_totalprice", "o_orderkey"], page=3, page_size=100)


@query(
    "select_where",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice >= 100000"
    " AND o_orderstatus <> 'F' AND o_orderkey < 5000",
)
def _(spark, d):
    rows = project.select_where(
        table(spark, d, "orders"),
        [("o_totalprice", ">=", 100000.0), ("o_orderstatus", "!=", "F"), ("o_orderkey", "<", 5000)],
    )
    return rows.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("select_columns", "SELECT p_partkey, p_brand FROM part")
def _(spark, d):
    return project.select_basic(table(spark, d, "part"), ["p_partkey", "p_brand"])


@query("select_ordered", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC")
def _(spark, d):
    return project.select_order_by(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], "DESC")


@query(
    "join_tables",
    "SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(spark, d):
    out = project.select_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")
    return out.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query(
    "group_count",
    "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL",
)
def _(spark, d):
    return project.group_count(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "aggregate_totals",
    "SELECT 'count' AS fn, CAST(count(*) AS DOUBLE) AS result FROM lineitem"
    " UNION ALL SELECT 'sum', round(sum(l_extendedprice), 2) FROM lineitem"
    " UNION ALL SELECT 'avg', round(avg(l_extendedprice), 2) FROM lineitem",
)
def _(spark, d):
    rows, out = table(spark, d, "lineitem"), None
    for fn in ("count", "sum", "avg"):
        part = project.aggregate(rows, fn, "l_extendedprice" if fn != "count" else None)
        part = part.select(F.lit(fn).alias("fn"), F.col(fn).cast("double").alias("result"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "result", digits=2)


@query(
    "stack_named_parts",
    "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS __sheet_name FROM customer"
    " UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'suppliers' FROM supplier",
)
def _(spark, d):
    customers = table(spark, d, "customer").selectExpr("c_custkey key", "c_acctbal balance", "c_mktsegment segment")
    suppliers = table(spark, d, "supplier").selectExpr("s_suppkey key", "s_acctbal balance")
    return dedup.union_parts({"customers": customers, "suppliers": suppliers})


@query(
    "enforce_schema",
    "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return readers.enforce_schema(rows, {"o_totalprice": "float", "o_orderdate": "date"})


@query(
    "clean_while_reading",
    "SELECT DISTINCT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber <> 3 THEN l_returnflag END, '?')"
    " AS l_returnflag FROM lineitem",
)
def _(spark, d):
    flag = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("l_returnflag"))
    return readers.read_clean(rows, fill={"l_returnflag": "?"})


@query(
    "catalog_table_read",
    "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
)
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("brightrow_customers")
    out = readers.read_table(spark, "brightrow_customers", {"c_mktsegment": "BUILDING", "c_nationkey": 7})
    return out.select("c_custkey", "c_nationkey", "c_mktsegment")


