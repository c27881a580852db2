"""String, date, number, null and mapping queries."""

from pyspark.sql import functions as F

from brightrow.columns import ref
from brightrow.operators import nulls, strings
from brightrow.suite.registry import SQL_SPACE, SQL_STRIP, digest, query, rounded, table

NULLED_EVENTS = """
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value
  FROM events
"""


def nulled_events(spark, d):
    """Events with holes: every fifth type and every seventh value missing."""
    return table(spark, d, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def padded_documents(spark, d):
    text = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n  "))
    return documents(spark, d).select("doc_id", text.alias("text"), "lang")


PADDED = "(SELECT doc_id, concat(' ', chr(9), text, chr(10), '  ') AS text, lang FROM documents)"


@query("trim_text", f"SELECT doc_id, md5(regexp_replace(text, {SQL_STRIP}, '', 'g')) AS text FROM {PADDED}")
def _(spark, d):
    return strings.trim(padded_documents(spark, d), ["text"]).select("doc_id", digest("text"))


@query("lowercase_text", "SELECT doc_id, md5(lower(text)) AS text, lower(source) AS source FROM documents")
def _(spark, d):
    out = strings.lower(documents(spark, d))
    return out.select("doc_id", digest("text"), "source")


@query("uppercase_text", "SELECT conv_id, turn, upper(role) AS role, md5(upper(replace(text, 'ß', 'ss'))) AS text FROM conversations")
def _(spark, d):
    out = strings.upper(table(spark, d, "conversations"))
    return out.select("conv_id", "turn", "role", digest("text"))


@query("squeeze_spaces", f"SELECT doc_id, md5(regexp_replace(text, '[{SQL_SPACE}]+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return strings.squeeze(documents(spark, d), ["text"]).select("doc_id", digest("text"))


@query(
    "strip_special_characters",
    f"SELECT doc_id, md5(regexp_replace(text, '[^0-9a-zA-Z{SQL_SPACE}]', '', 'g')) AS text FROM documents",
)
def _(spark, d):
    return strings.strip_special(documents(spark, d), ["text"]).select("doc_id", digest("text"))


@query(
    "regex_replace_columns",
    "SELECT c_custkey, regexp_replace(c_name, '^Customer#0*', '', 'g') AS c_name,"
    " regexp_replace(c_mktsegment, '[AEIOU]', '', 'g') AS c_mktsegment FROM customer",
)
def _(spark, d):
    out = strings.regex_replace(
        table(spark, d, "customer"), {"c_name": "^Customer#0*", "c_mktsegment": "[AEIOU]"}
    )
    return out.select("c_custkey", "c_name", "c_mktsegment")


@query("fix_encoding", "SELECT doc_id, md5(text) AS text FROM documents")
def _(spark, d):
    return strings.fix_encoding(table(spark, d, "documents"), ["text"]).select("doc_id", digest("text"))


@query(
    "strip_affixes",
    "SELECT s_suppkey, CASE WHEN ends_with(s, '0') THEN left(s, length(s) - 1) ELSE s END AS s_name FROM"
    " (SELECT s_suppkey, CASE WHEN starts_with(s_name, 'Supplier#') THEN substr(s_name, 10) ELSE s_name END AS s"
    " FROM supplier)",
)
def _(spark, d):
    out = strings.strip_affixes(table(spark, d, "supplier"), ["s_name"], "Supplier#", "0")
    return out.select("s_suppkey", "s_name")


@query(
    "cast_to_text",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders",
)
def _(spark, d):
    out = strings.to_text(table(spark, d, "orders"), ["o_custkey"])
    return out.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "uppercase_status",
    "SELECT o_orderkey, upper(lower(o_orderstatus)) AS status FROM orders",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("status"))
    return strings.upper_column(orders, "status")


# Durations in each of the accepted layouts, made from the line items.
_DURATION = (
    "CASE pmod(l_orderkey, 4)"
    " WHEN 0 THEN concat_ws(':', l_linenumber, l_quantity, l_partkey % 60)"
    " WHEN 1 THEN concat_ws(':', l_linenumber, l_quantity)"
    " WHEN 2 THEN cast(l_quantity AS string) ELSE 'n/a' END"
)


@query(
    "duration_to_seconds",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           CASE l_orderkey % 4
             WHEN 0 THEN l_linenumber * 3600 + l_quantity * 60 + l_partkey % 60
             WHEN 1 THEN l_linenumber * 60 + l_quantity
             WHEN 2 THEN l_quantity END AS duration
    FROM lineitem
    """,
)
def _(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    rows = table(spark, d, "lineitem").select(*keys, F.expr(_DURATION).alias("duration"))
    return strings.normalize_duration(rows, "duration")


@query(
    "resolution_text",
    "SELECT p_partkey, concat(p_size * 16, 'x', p_size * 9) AS resolution FROM part",
)
def _(spark, d):
    text = F.concat(F.lit("res: "), F.col("p_size") * 16, F.lit(" x "), F.col("p_size") * 9, F.lit(" PIX"))
    rows = table(spark, d, "part").select("p_partkey", text.alias("resolution"))
    return strings.normalize_resolution(rows)


@query(
    "dimensions_to_numbers",
    "SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS width,"
    " p_retailprice AS height FROM part",
)
def _(spark, d):
    part = table(spark, d, "part")
    width = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("string")).otherwise("wide")
    rows = part.select("p_partkey", width.alias("width"), F.col("p_retailprice").cast("string").alias("height"))
    return strings.to_numbers(rows)


@query(
    "parse_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS o_orderdate FROM orders",
)
def _(spark, d):
    layouts = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss"]
    text = F.lit("no date")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("o_orderkey") % 6 == i + 1, F.date_format("o_orderdate", layout)).otherwise(text)
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("o_orderdate"))
    out = strings.parse_dates(rows, ["o_orderdate"])
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "date_parts",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_orderdate_year, CAST(month(o_orderdate) AS INT)"
    " AS o_orderdate_month, CAST(day(o_orderdate) AS INT) AS o_orderdate_day FROM orders",
)
def _(spark, d):
    out = strings.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return out.drop("o_orderdate")


@query(
    "auto_cast_numbers",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line_text,
           CASE WHEN l_quantity > 1 THEN l_extendedprice END AS price_text,
           CASE WHEN l_partkey % 100 = 0 THEN 'none' ELSE CAST(l_partkey AS VARCHAR) END AS mixed_text
    FROM lineitem
    """,
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.concat(F.lit(" "), F.col("l_linenumber")).alias("line_text"),
        F.when(F.col("l_quantity") > 1, F.col("l_extendedprice").cast("string")).otherwise("").alias("price_text"),
        F.when(F.col("l_partkey") % 100 == 0, "none").otherwise(F.col("l_partkey").cast("string")).alias("mixed_text"),
    )
    return strings.auto_cast(rows)


@query(
    "convert_types",
    "SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey,"
    " TRY_CAST(left(o_orderpriority, 1) AS INT) AS priority FROM orders",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("priority")
    )
    rows = strings.convert(rows, {"o_custkey": "int"})
    return strings.convert(rows, {"priority": "int"}, errors="null")


@query(
    "round_half_even",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,"
    " round_even(l_quantity / 2, 0) AS half FROM lineitem",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") / 2).alias("half")
    )
    return strings.round_numeric(rows, ["half"], 0)


@query("scale_by_factor", "SELECT event_id, round(value * 0.5, 6) AS value FROM events")
def _(spark, d):
    out = strings.scale(table(spark, d, "events").select("event_id", "value"), {"value": 0.5})
    return rounded(out, "value")


@query(
    "custom_function",
    "SELECT event_id, concat('<', event_type, '>') AS event_type, CASE WHEN value IS NOT NULL"
    f" THEN round(sqrt(value), 6) END AS value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "event_type", "value")
    rows = rows.withColumn("event_type", F.coalesce("event_type", F.lit("")))
    out = strings.apply_fn(rows, "event_type", lambda c: F.concat(F.lit("<"), c, F.lit(">")))
    return rounded(strings.apply_numeric(out, {"value": F.sqrt}), "value")


def _upper_first(s):
    return s.str.capitalize()


@query(
    "custom_pandas_function",
    "SELECT event_id, concat(upper(left(event_type, 1)), lower(substr(event_type, 2))) AS event_type FROM events",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return strings.apply_fn(rows, "event_type", _upper_first, "string")


_ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def sql_html_text(source: str) -> str:
    """Text of simple markup in SQL: hidden elements, comments and tags out, entities decoded."""
    out = source
    for pattern in (r"(?is)<(script|style|template)\b.*?</(script|style|template)>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    for entity, char in _ENTITIES:
        out = f"replace({out}, '{entity}', '{char}')"
    return out


@query("strip_html_tags", f"SELECT page_id, {sql_html_text('html')} AS html FROM pages")
def _(spark, d):
    return strings.strip_html(table(spark, d, "pages").select("page_id", "html"), ["html"])


@query(
    "fill_missing",
    f"SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, 0) AS value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "event_type", "value")
    return nulls.fill(nulls.fill(rows, "unknown"), 0.0, ["value"])


@query(
    "fill_by_column",
    f"SELECT event_id, coalesce(event_type, 'none') AS event_type, coalesce(value, -1) AS value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "event_type", "value")
    return nulls.fill_map(rows, {"event_type": "none", "value": -1.0, "absent": 0})


@query(
    "drop_rows_with_null",
    f"SELECT event_id, event_type, value FROM ({NULLED_EVENTS}) WHERE value IS NOT NULL",
)
def _(spark, d):
    return nulls.drop_null(nulled_events(spark, d).select("event_id", "event_type", "value"), ["value"])


@query(
    "drop_empty_rows",
    f"SELECT event_type, value FROM ({NULLED_EVENTS}) WHERE event_type IS NOT NULL OR value IS NOT NULL",
)
def _(spark, d):
    return nulls.drop_empty_rows(nulled_events(spark, d).select("event_type", "value"))


@query(
    "drop_rows_below_threshold",
    f"SELECT event_id, event_type, value FROM ({NULLED_EVENTS})"
    " WHERE 1 + (event_type IS NOT NULL)::INT + (value IS NOT NULL)::INT >= 2",
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "event_type", "value")
    return nulls.drop_missing(rows, thresh=2)


@query("drop_columns_with_null", f"SELECT event_id, ts, user_id FROM ({NULLED_EVENTS})")
def _(spark, d):
    return nulls.drop_missing(nulled_events(spark, d), axis="columns")


@query(
    "map_categories",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry'"
    " ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return nulls.map_values(rows, "c_mktsegment", {"BUILDING": "construction", "MACHINERY": "industry"})


@query(
    "replace_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END AS"
    " o_orderstatus, CASE WHEN o_custkey = 1 THEN 0 ELSE o_custkey END AS o_custkey FROM orders",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    rows = nulls.replace(rows, {1: 0}, "o_custkey")
    return nulls.replace(rows, {"F": "O", "O": "F"})


@query(
    "one_hot_segments",
    """
    SELECT c_custkey, coalesce(c_mktsegment = 'BUILDING', false) AS "seg_BUILDING",
           coalesce(c_mktsegment = 'FURNITURE', false) AS "seg_FURNITURE",
           coalesce(c_mktsegment = 'HOUSEHOLD', false) AS "seg_HOUSEHOLD",
           coalesce(c_mktsegment = 'MACHINERY', false) AS "seg_MACHINERY"
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)
    """,
)
def _(spark, d):
    segment = F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", segment.alias("seg"))
    return nulls.one_hot(rows, ["seg"])


@query(
    "hash_encode_brands",
    "SELECT p_brand, count(*) AS n, 1::BIGINT AS codes, true AS in_range FROM part GROUP BY p_brand",
)
def _(spark, d):
    """The code of a brand is one number below the bucket count, whatever the run."""
    rows = table(spark, d, "part").select("p_brand", F.col("p_brand").alias("code"))
    coded = nulls.hash_encode(rows, ["code"], buckets=10000)
    return coded.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("code").alias("codes"),
        F.bool_and(F.col("code").between(0, 9999)).alias("in_range"),
    )


@query(
    "distinct_list_items",
    """
    SELECT doc_id, md5(coalesce(string_agg(w, ' ' ORDER BY first_pos), '')) AS items
    FROM (
      SELECT doc_id, w, min(pos) AS first_pos
      FROM (
        SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents)
      ) GROUP BY doc_id, w
    ) GROUP BY doc_id
    """,
)
def _(spark, d):
    from brightrow.operators.dedup import dedup_list

    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w != "")
    rows = table(spark, d, "documents").select("doc_id", words.alias("items"))
    return dedup_list(rows, "items").select("doc_id", F.md5(F.array_join(ref("items"), " ")).alias("items"))
