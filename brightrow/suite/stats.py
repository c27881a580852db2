"""Scaling, outlier, summary and size queries."""

from pyspark.sql import functions as F

from brightrow.operators import scaling
from brightrow.sources import layout
from brightrow.suite.registry import query, rounded, table
from brightrow.suite.strings import NULLED_EVENTS, nulled_events

_PARTS = "p_partkey, round((p_size - avg(p_size) OVER ()) / {sd}(p_size) OVER (), 6) AS p_size"


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.lit(5).alias("same"))


@query(
    "standardize_population",
    f"SELECT {_PARTS.format(sd='stddev_pop')}, 0.0::DOUBLE AS same FROM part",
)
def _(spark, d):
    return rounded(scaling.standardize(_part(spark, d), ["p_size", "same"]), "p_size", "same")


@query(
    "standardize_sample",
    f"SELECT {_PARTS.format(sd='stddev_samp')}, CAST(NULL AS DOUBLE) AS same FROM part",
)
def _(spark, d):
    return rounded(scaling.standardize(_part(spark, d), ["p_size", "same"], ddof=1), "p_size", "same")


@query(
    "minmax_scale",
    "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6)"
    " AS p_size, 0.0::DOUBLE AS same FROM part",
)
def _(spark, d):
    return rounded(scaling.minmax(_part(spark, d), ["p_size", "same"]), "p_size", "same")


@query(
    "minmax_scale_or_null",
    "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6)"
    " AS p_size, CAST(NULL AS DOUBLE) AS same FROM part",
)
def _(spark, d):
    return rounded(scaling.minmax(_part(spark, d), ["p_size", "same"], constant=None), "p_size", "same")


@query(
    "flag_outliers",
    "SELECT event_id, value, coalesce(abs(value - avg(value) OVER ()) / stddev_samp(value) OVER () > 3, false)"
    f" AS outlier_value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    return scaling.flag_outliers(nulled_events(spark, d).select("event_id", "value"), "value")


_SEQUENTIAL = """
  WITH a AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem),
       x AS (SELECT l.* FROM lineitem l, a WHERE abs((l_extendedprice - m) / s) <= 1.5),
       b AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM x),
       y AS (SELECT x.* FROM x, b WHERE abs((l_quantity - m) / s) <= 1.5),
       c AS (SELECT avg(l_discount) AS m, stddev_pop(l_discount) AS s FROM y)
  SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount
  FROM y, c WHERE abs((l_discount - m) / s) <= 1.5
"""


def _prices(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"
    )


@query("remove_outliers_in_sequence", _SEQUENTIAL)
def _(spark, d):
    return scaling.remove_outliers(_prices(spark, d), ["l_extendedprice", "l_quantity", "l_discount"], z=1.5)


@query(
    "remove_outliers_jointly",
    """
    WITH a AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_quantity) AS m2,
                      stddev_pop(l_quantity) AS s2 FROM lineitem)
    SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount FROM lineitem, a
    WHERE abs((l_extendedprice - m1) / s1) <= 1.5 AND abs((l_quantity - m2) / s2) <= 1.5
    """,
)
def _(spark, d):
    return scaling.remove_outliers(_prices(spark, d), ["l_extendedprice", "l_quantity"], z=1.5, mode="joint")


@query(
    "remove_outliers_strictly",
    "WITH a AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"
    " SELECT event_id, value FROM events, a WHERE abs((value - m) / s) < 3",
)
def _(spark, d):
    return scaling.remove_outliers(table(spark, d, "events").select("event_id", "value"), ["value"], inclusive=False)


@query(
    "null_outliers_within_record",
    """
    WITH v AS (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
             [l_quantity, l_discount, l_tax] AS xs FROM lineitem),
    s AS (SELECT *, list_avg(xs) AS m, sqrt(list_avg(list_transform(xs, lambda x: (x - list_avg(xs)) * (x - list_avg(xs))))) AS sd FROM v)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN NOT (sd > 0 AND abs((l_quantity - m) / sd) > 1.41) THEN l_quantity END AS l_quantity,
           CASE WHEN NOT (sd > 0 AND abs((l_discount - m) / sd) > 1.41) THEN l_discount END AS l_discount,
           CASE WHEN NOT (sd > 0 AND abs((l_tax - m) / sd) > 1.41) THEN l_tax END AS l_tax
    FROM s
    """,
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    return scaling.null_record_outliers(rows, ["l_quantity", "l_discount", "l_tax"], z=1.41)


@query(
    "count_anomalies",
    "WITH a AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)"
    " SELECT 'value' AS column, count(*) FILTER (abs((value - m) / s) > 3) AS anomalies FROM events, a",
)
def _(spark, d):
    return scaling.count_anomalies(table(spark, d, "events"), "value")


@query(
    "summarize_numbers",
    """
    WITH t AS (SELECT count(*) AS n FROM customer)
    SELECT 'c_custkey' AS column, 'bigint' AS type, count(c_custkey) AS known, round(avg(c_custkey), 4) AS mean,
           round(stddev_samp(c_custkey), 4) AS std, CAST(min(c_custkey) AS DOUBLE) AS min,
           CAST(max(c_custkey) AS DOUBLE) AS max, count(*) AS rows, 5 AS columns FROM customer
    UNION ALL
    SELECT 'c_nationkey', 'int', count(c_nationkey), round(avg(c_nationkey), 4), round(stddev_samp(c_nationkey), 4),
           CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE), count(*), 5 FROM customer
    UNION ALL
    SELECT 'c_acctbal', 'double', count(c_acctbal), round(avg(c_acctbal), 4), round(stddev_samp(c_acctbal), 4),
           min(c_acctbal), max(c_acctbal), count(*), 5 FROM customer
    """,
)
def _(spark, d):
    return rounded(scaling.summarize(table(spark, d, "customer")), "mean", "std", digits=4)


@query(
    "trend_per_type",
    """
    SELECT event_type, round((arg_max(value, ts) - arg_min(value, ts)) / count(*), 8) AS slope,
           CASE WHEN arg_max(value, ts) > arg_min(value, ts) THEN 'Upward trend detected.'
                WHEN arg_max(value, ts) < arg_min(value, ts) THEN 'Downward trend detected.'
                ELSE 'No significant trend detected.' END AS trend
    FROM events GROUP BY event_type
    """,
)
def _(spark, d):
    out = scaling.detect_trend(table(spark, d, "events"), "ts", "value", ["event_type"], ["event_id"])
    return rounded(out, "slope", digits=8)


@query(
    "table_growth",
    "SELECT 'orders' AS \"table\", count(*) AS rows, count(*) > 2000 AS alert FROM orders"
    " UNION ALL SELECT 'region', count(*), count(*) > 2000 FROM region",
)
def _(spark, d):
    tables = {"orders": table(spark, d, "orders"), "region": table(spark, d, "region")}
    return scaling.table_growth(tables, 2000)


@query(
    "table_sizes",
    "SELECT * FROM (VALUES ('lineitem', 1::BIGINT, true), ('orders', 1::BIGINT, true), ('documents', 1::BIGINT, true))"
    ' v("table", files, alert)',
)
def _(spark, d):
    names = ("lineitem", "orders", "documents")
    return layout.table_sizes(spark, {n: f"{d}/{n}.parquet" for n in names}, 1000).drop("bytes")
