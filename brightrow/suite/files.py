"""Readers, writers, nested data and HTML, over files that Spark derives from the tables."""

from pyspark.sql import functions as F

from brightrow.operators import html, nested
from brightrow.session import durable
from brightrow.sources import ingest, readers, sinks
from brightrow.suite.registry import query, scratch, table
from brightrow.suite.strings import sql_html_text


@query("csv_read", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    path = scratch(spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    sinks.export_files(table(spark, d, "orders").select(*columns), path, "csv")
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}
    return readers.read_csv(spark, path, types)


@query(
    "csv_read_quoted",
    "SELECT conv_id, turn, role, md5(text) AS text FROM conversations",
)
def _(spark, d):
    path = scratch(spark, "csv")
    rows = table(spark, d, "conversations")
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    types = {"conv_id": "bigint", "turn": "bigint"}
    out = readers.read_csv(spark, path, types, delimiter=";", multi_line=True)
    return out.withColumn("text", F.md5("text"))


def _nested_orders(spark, d, total="o_totalprice"):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("o_custkey").alias("customer"),
            F.struct(F.expr(total).alias("total"), F.col("o_orderstatus").alias("status")).alias("state"),
        ).alias("head"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
    )


_NESTED = (
    'SELECT o_orderkey AS id, o_custkey AS "head.customer", o_totalprice AS "head.state.total",'
    ' o_orderstatus AS "head.state.status"'
)


@query("json_read_flat", f"{_NESTED} FROM orders")
def _(spark, d):
    path = scratch(spark, "json")
    sinks.export_files(_nested_orders(spark, d), path, "json")
    return readers.read_json(spark, path, lines=True).drop("tags")


@query("parquet_read", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(spark, d):
    path = scratch(spark, "parquet")
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows.write.partitionBy("c_mktsegment").parquet(path)
    return readers.read_parquet(spark, path, {"c_acctbal": "double"})


@query("orc_read", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    path = scratch(spark, "orc")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.orc(path)
    return readers.read_orc(spark, path, {"s_suppkey": "bigint"})


@query(
    "xml_read",
    'SELECT p_partkey AS "@id", p_name AS name, p_brand AS "maker.brand", CAST(p_size AS BIGINT) AS "maker.size" FROM part',
)
def _(spark, d):
    path = scratch(spark, "xml")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("@id"),
        F.array(F.lit("first"), F.col("p_name")).alias("name"),
        F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("maker"),
    )
    rows.write.format("xml").option("rowTag", "part").option("rootTag", "parts").option("attributePrefix", "@").save(path)
    return readers.read_xml(spark, path, "part")


def _log_lines(spark, d, line):
    path = scratch(spark, "log")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return path


@query(
    "log_read_system",
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, concat('host', user_id) AS host, event_type AS process,"
    " concat('event ', event_id) AS message FROM events WHERE event_id % 10 <> 0",
)
def _(spark, d):
    text = F.concat_ws(
        " ",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.lit("host"), "user_id"),
        F.concat("event_type", F.lit(":")),
        F.concat(F.lit("event "), "event_id"),
    )
    line = F.when(F.col("event_id") % 10 != 0, text).when(F.col("event_id") % 20 == 0, "").otherwise("no layout")
    return readers.read_logs(spark, _log_lines(spark, d, line), "syslog")


@query(
    "log_read_classic",
    "SELECT CASE WHEN event_id % 10 <> 0 THEN concat(strftime(ts, '%b'), ' ', lpad(CAST(day(ts) AS VARCHAR), 2, '0'),"
    " ' ', strftime(ts, '%H:%M:%S')) END AS timestamp, CASE WHEN event_id % 10 <> 0 THEN concat('host', user_id) END"
    " AS host, CASE WHEN event_id % 10 <> 0 THEN event_type END AS service, CASE WHEN event_id % 10 <> 0 THEN"
    " concat('event ', event_id) END AS message, CASE WHEN event_id % 10 = 0 THEN concat('raw ', event_id) END AS line"
    " FROM events",
)
def _(spark, d):
    text = F.concat_ws(
        " ",
        F.date_format("ts", "MMM dd HH:mm:ss"),
        F.concat(F.lit("host"), "user_id"),
        F.concat("event_type", F.lit(":")),
        F.concat(F.lit("event "), "event_id"),
    )
    line = F.when(F.col("event_id") % 10 != 0, text).otherwise(F.concat(F.lit("raw "), "event_id"))
    return readers.read_logs(spark, _log_lines(spark, d, line), "syslog", keep_unmatched=True)


@query(
    "log_read_pattern",
    "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_type <> 'view'",
)
def _(spark, d):
    line = F.when(F.col("event_type") != "view", F.concat_ws("|", "event_id", "event_type")).otherwise("?")
    return readers.read_logs(spark, _log_lines(spark, d, line), "text", r"(?P<id>\d+)\|(?P<kind>\w+)")


@query("log_read_plain", "SELECT concat('event ', event_id) AS raw_line FROM events")
def _(spark, d):
    line = F.concat(F.lit("  event "), "event_id", F.lit(" "))
    return readers.read_logs(spark, _log_lines(spark, d, line))


@query(
    "log_read_json",
    "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id % 4 <> 0",
)
def _(spark, d):
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    line = F.when(F.col("event_id") % 4 != 0, good).otherwise("{broken")
    return readers.read_logs(spark, _log_lines(spark, d, line), "json", struct="id bigint, kind string")


@query(
    "yaml_read",
    'SELECT c_custkey AS id, c_mktsegment AS "info.segment", c_acctbal AS "info.balance" FROM customer',
)
def _(spark, d):
    path = scratch(spark, "yaml")
    rows = table(spark, d, "customer")
    item = F.format_string(
        "- {id: %d, info: {segment: %s, balance: %s}}", "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("string")
    )
    rows.repartition(8).select(item.alias("value")).write.text(path)
    schema = "id bigint, info struct<segment string, balance double>"
    return readers.read_yaml(spark, path, ["id"], schema=schema)


@query(
    "sensor_readings",
    "SELECT DISTINCT ts AS timestamp, user_id, value FROM events WHERE event_id % 8 <> 0",
)
def _(spark, d):
    text = F.when(F.col("event_id") % 8 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("soon")
    rows = table(spark, d, "events").select(text.alias("timestamp"), "user_id", "value")
    twice = rows.unionByName(rows)
    out = readers.normalize_sensor(twice, expected=["timestamp", "value"])
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("flatten_structs", f"{_NESTED.replace('.', '_')}, concat(o_orderpriority, ',', o_orderstatus) AS tags FROM orders")
def _(spark, d):
    flat = nested.flatten(_nested_orders(spark, d), "_")
    return flat.withColumn("tags", F.array_join("tags", ","))


@query(
    "flatten_lists_to_json",
    f"{_NESTED}, concat('[\"', o_orderpriority, '\",\"', o_orderstatus, '\"]') AS tags FROM orders",
)
def _(spark, d):
    return nested.flatten(_nested_orders(spark, d), ".", arrays="json")


@query(
    "flatten_indexed_paths",
    "SELECT o_orderkey AS id, 'head.customer' AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL"
    " SELECT o_orderkey, 'head.state.status', o_orderstatus FROM orders UNION ALL"
    " SELECT o_orderkey, 'head.state.total', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders UNION ALL"
    " SELECT o_orderkey, 'tags[0]', o_orderpriority FROM orders UNION ALL"
    " SELECT o_orderkey, 'tags[1]', o_orderstatus FROM orders",
)
def _(spark, d):
    return nested.flatten_indexed(_nested_orders(spark, d, "floor(o_totalprice)"), ["id"])


@query(
    "widen_paths",
    'SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS "head.customer", o_orderstatus AS "head.state.status",'
    ' CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS "head.state.total",'
    ' o_orderpriority AS "tags[0]", o_orderstatus AS "tags[1]" FROM orders',
)
def _(spark, d):
    return nested.widen(_nested_orders(spark, d, "floor(o_totalprice)"), ["id"])


@query(
    "parse_json_text",
    "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events",
)
def _(spark, d):
    rows = nested.parse_json(table(spark, d, "events").select("event_id", "props"), "props")
    return nested.flatten(rows).withColumnRenamed("props.k", "k")


@query(
    "parse_messages",
    "SELECT event_id, CASE WHEN event_id % 6 NOT IN (0, 1) THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k,"
    " CASE WHEN event_id % 6 = 0 THEN 'oops {' WHEN event_id % 6 = 1 THEN event_type END AS raw FROM events",
)
def _(spark, d):
    payload = (
        F.when(F.col("event_id") % 6 == 0, "oops {")
        .when(F.col("event_id") % 6 == 1, F.col("event_type"))
        .otherwise(F.col("props"))
    )
    rows = table(spark, d, "events").select("event_id", payload.alias("payload"))
    return nested.parse_messages(rows, "payload", "k bigint", keep=["event_id"])


@query(
    "payload_to_columns",
    'SELECT o_orderkey AS id, o_orderstatus AS "head.status", concat(\'["\', o_orderpriority, \'"]\') AS tags,'
    " CAST(NULL AS VARCHAR) AS value FROM orders WHERE o_orderkey % 3 <> 0"
    " UNION ALL SELECT NULL, NULL, NULL, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0",
)
def _(spark, d):
    record = F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_orderstatus").alias("status")).alias("head"),
        F.array("o_orderpriority").alias("tags"),
    )
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
        .when(F.col("o_orderkey") % 3 == 1, F.to_json(F.array(record)))
        .otherwise(F.to_json(record))
    )
    rows = table(spark, d, "orders").select(text.alias("body"))
    return nested.payload_columns(rows, "body", "id bigint, head struct<status string>, tags array<string>")


@query("last_repeated_child", "SELECT o_orderkey AS id, o_orderstatus AS tags FROM orders")
def _(spark, d):
    return nested.last_repeated(_nested_orders(spark, d)).select("id", "tags")


@query(
    "html_headings",
    "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1[ >]')) FROM pages) GROUP BY 1",
)
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return html.html_select(pages, "html", "page_id", ["h1"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def _elements(selector: str, source: str, tag: str) -> str:
    found = f"regexp_extract_all({source}, '(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1)"
    return (
        f"SELECT page_id, '{selector}' AS selector, CAST(unnest(range(len(f))) AS INT) AS position,"
        f" {sql_html_text('trim(unnest(f))')} AS text FROM (SELECT page_id, {found} AS f FROM pages)"
    )


_NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@query(
    "html_elements",
    " UNION ALL ".join([_elements("title", "html", "title"), _elements("nav a", _NAV, "a"), _elements("h1", "html", "h1")]),
)
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return html.html_select(pages, "html", "page_id", ["title", "nav a", "h1"])


def _order_pages(spark, d):
    """One HTML page per order with a table of its fields."""
    cells = [
        F.concat(F.lit(f"<tr><td> {name} </td><td><b>"), F.col(col), F.lit("</b> &amp; co</td></tr>\n"))
        for name, col in (("Status", "o_orderstatus"), ("Priority", "o_orderpriority"))
    ]
    head = "<html><body><h1>Order</h1><table><tr><th>Field</th><th>Value</th></tr>"
    page = F.concat(F.lit(head), *cells, F.lit("</table></body></html>"))
    return table(spark, d, "orders").select("o_orderkey", page.alias("html"))


@query(
    "html_tables",
    "SELECT o_orderkey, 0::INT AS row_index, 'Status' AS \"Field\", concat(o_orderstatus, ' & co') AS \"Value\" FROM orders"
    " UNION ALL SELECT o_orderkey, 1::INT, 'Priority', concat(o_orderpriority, ' & co') FROM orders",
)
def _(spark, d):
    found = html.html_tables(_order_pages(spark, d), "html", "o_orderkey")
    return html.table_columns(found, ["Field", "Value"], "o_orderkey").drop("__table_index")


@query(
    "html_text_of_tables",
    "SELECT o_orderkey, concat('OrderFieldValue Status ', o_orderstatus, ' & co', chr(10), ' Priority ', o_orderpriority,"
    " ' & co', chr(10)) AS text FROM orders",
)
def _(spark, d):
    return _order_pages(spark, d).select("o_orderkey", html.visible_text("html").alias("text"))


@query(
    "append_load",
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation",
)
def _(spark, d):
    path = scratch(spark, "loaded")
    sinks.load_table(table(spark, d, "nation").selectExpr("n_nationkey r_regionkey", "n_name r_name"), path)
    sinks.load_table(table(spark, d, "region"), path)
    return spark.read.parquet(path)


@query("overwrite_load", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    path = scratch(spark, "loaded")
    sinks.load_table(table(spark, d, "nation").selectExpr("n_nationkey r_regionkey", "n_name r_name"), path)
    sinks.load_table(table(spark, d, "region"), path, overwrite=True)
    return spark.read.parquet(path)


@query(
    "upsert_orders",
    """
    WITH u AS (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice AS c_acctbal FROM orders
               QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)
    UNION ALL SELECT c_custkey, c_acctbal FROM u
    """,
)
def _(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    updates = table(spark, d, "orders").selectExpr("o_custkey c_custkey", "o_totalprice c_acctbal", "o_orderkey")
    return sinks.upsert(base, updates, ["c_custkey"], ["o_orderkey"])


@query(
    "upsert_partitioned_customers",
    """
    WITH old AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer),
    u AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, 'BUILDING' AS c_mktsegment FROM old
          WHERE c_mktsegment = 'BUILDING' OR c_custkey = (SELECT min(c_custkey) FROM old WHERE c_mktsegment = 'MACHINERY')),
    new AS (SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT * FROM u)
    SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance,
           c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS files_kept FROM new GROUP BY 1
    """,
)
def _(spark, d):
    """Updates of one segment, and one customer that moves there: the other segments' files stay."""
    path = scratch(spark, "segments")
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    customers.repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    files = lambda: spark.read.parquet(path).select("c_mktsegment", "_metadata.file_name").distinct()
    before = durable(files())
    moved = F.min(F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_custkey")))
    first = customers.agg(moved).first()[0]
    updates = customers.where((F.col("c_mktsegment") == "BUILDING") | (F.col("c_custkey") == first)).select(
        "c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")
    )
    sinks.upsert_table(spark, path, updates, ["c_custkey"], ["c_acctbal"], ["c_mktsegment"])
    kept = files().join(before.withColumn("old", F.lit(True)), ["c_mktsegment", "file_name"], "left")
    kept = kept.groupBy("c_mktsegment").agg(F.bool_and(F.coalesce("old", F.lit(False))).alias("files_kept"))
    found = spark.read.parquet(path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )
    return found.join(kept, "c_mktsegment").select("c_mktsegment", "customers", "balance", "files_kept")


@query("copy_files_into_table", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    source, target = scratch(spark, "copy"), scratch(spark, "copied")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    sinks.export_files(rows, f"{source}/csv", "csv")
    sinks.export_files(rows, f"{source}/parquet", "parquet")
    sinks.copy_into(spark, f"{source}/csv", "csv", target, {"s_suppkey": "bigint", "s_acctbal": "double"})
    sinks.copy_into(spark, f"{source}/parquet", "parquet", target)
    return spark.read.parquet(target)


@query(
    "ingest_several_formats",
    "SELECT * FROM (VALUES ('csv', 'staged', CAST((SELECT count(*) FROM supplier) AS BIGINT)), ('jsonl', 'staged',"
    " (SELECT count(*) FROM nation)), ('parquet', 'rejected', 0), (NULL, 'failed', 0)) v(format, status, rows)",
)
def _(spark, d):
    path = scratch(spark, "inbox")
    table(spark, d, "supplier").write.option("header", True).csv(f"{path}/supplier.csv")
    table(spark, d, "nation").write.json(f"{path}/nation.jsonl")
    table(spark, d, "region").write.parquet(f"{path}/region.parquet")
    files = [f"{path}/{n}" for n in ("supplier.csv", "nation.jsonl", "region.parquet", "notes.txt")]

    def check(df) -> bool:
        return "r_regionkey" not in df.columns

    found = ingest.ingest_files(spark, files, f"{path}/staged", check).collect()
    out = None
    for row in found:
        n = F.lit(0).cast("long") if row["staged"] is None else F.count(F.lit(1))
        source = table(spark, d, "region") if row["staged"] is None else spark.read.parquet(row["staged"])
        part = source.agg(n.alias("rows")).select(
            F.lit(row["format"]).cast("string").alias("format"), F.lit(row["status"]).alias("status"), "rows"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("ingest_same_names", "SELECT CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS BIGINT) AS rows")
def _(spark, d):
    """Two files of one name in different folders are staged apart."""
    path = scratch(spark, "inbox")
    files = [f"{path}/{n}/x.csv" for n in ("nation", "region")]
    for name, file in zip(("nation", "region"), files):
        table(spark, d, name).write.option("header", True).csv(file)
    found = ingest.ingest_files(spark, files, f"{path}/staged", lambda df: True).collect()
    parts = [spark.read.parquet(r["staged"]).select(F.lit(1).alias("one")) for r in found]
    return parts[0].unionByName(parts[1]).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "ingest_checked_files",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS staged, 1::BIGINT AS rejected FROM"
    " (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)",
)
def _(spark, d):
    """One file per flag, all checked by one job; the file whose rows have the flag A is rejected."""
    path = scratch(spark, "inbox")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    files = [f"{path}/{flag}.csv" for flag in ("A", "N", "R")]
    for flag, file in zip("ANR", files):
        rows.where(F.col("l_returnflag") == flag).write.option("header", True).csv(file)
    accept = F.count_if(F.col("l_returnflag") == "A") == 0
    found = ingest.ingest_checked_files(spark, files, f"{path}/staged", accept).collect()
    staged = [r["staged"] for r in found if r["status"] == "staged"]
    return spark.read.parquet(*set(staged)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(staged)).cast("long").alias("staged"),
        F.lit(sum(r["status"] == "rejected" for r in found)).cast("long").alias("rejected"),
    )
