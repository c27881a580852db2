"""Deduplication queries."""

from pyspark.sql import functions as F

from brightrow.operators import dedup
from brightrow.operators.anchors import dedup_time_window, dedup_tolerance
from brightrow.operators.similarity import dedup_cosine, dedup_fuzzy
from brightrow.suite.registry import query, table

# A total order of the line items.
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
_ASC = ", ".join(LINE_ORDER)
_DESC = ", ".join(f"{c} DESC" for c in LINE_ORDER)
_LINE_KEY = ["l_orderkey", "l_linenumber"]


def _one(order: str, key: str = "l_orderkey, l_linenumber") -> str:
    return f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


@query("dedup_exact_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(spark, d):
    return dedup.dedup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("dedup_exact_subset", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, d):
    return dedup.dedup(table(spark, d, "lineitem"), _LINE_KEY).select(*_LINE_KEY)


@query("dedup_keep_first", _one(_ASC))
def _(spark, d):
    return dedup.dedup_first(table(spark, d, "lineitem"), _LINE_KEY, LINE_ORDER)


@query("dedup_keep_last", _one(_DESC))
def _(spark, d):
    return dedup.dedup_last(table(spark, d, "lineitem"), _LINE_KEY, LINE_ORDER)


@query("dedup_keep_largest", _one(f"l_extendedprice DESC, {_ASC}"))
def _(spark, d):
    return dedup.dedup_keep_max(table(spark, d, "lineitem"), "l_extendedprice", _LINE_KEY, LINE_ORDER)


@query("dedup_keep_smallest", _one(f"l_extendedprice, {_ASC}"))
def _(spark, d):
    return dedup.dedup_keep_min(table(spark, d, "lineitem"), "l_extendedprice", _LINE_KEY, LINE_ORDER)


@query(
    "dedup_several_columns",
    "SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2, 3",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return dedup.dedup(rows, ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderkey"])


@query(
    "dedup_ignoring_case",
    "SELECT min(doc_id) AS doc_id, md5(lower(text)) AS text FROM documents GROUP BY lower(text)",
)
def _(spark, d):
    out = dedup.dedup_ignore_case(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"])
    return out.select("doc_id", F.md5("text").alias("text"))


@query(
    "dedup_trimmed_text",
    "SELECT min(doc_id) AS doc_id, md5(trim(text)) AS text FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0"
    " THEN concat('  ', text) ELSE concat(text, ' ') END AS text FROM documents) GROUP BY trim(text)",
)
def _(spark, d):
    padded = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), "text")).otherwise(F.concat("text", F.lit(" ")))
    rows = table(spark, d, "documents").select("doc_id", padded.alias("text"))
    return dedup.dedup_trimmed(rows, "text", ["doc_id"]).select("doc_id", F.md5("text").alias("text"))


_COMBINED = (
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER"
    " (PARTITION BY concat(o_custkey, '_', o_orderstatus) ORDER BY o_orderkey) = 1"
)


@query("dedup_combined_key", _COMBINED)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return dedup.dedup_combined(rows, ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query("dedup_by_digest", _COMBINED)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return dedup.dedup_hash(rows, ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query(
    "dedup_rounded_value",
    "SELECT min(event_id) AS event_id, round_even(value, 0) AS value FROM events GROUP BY round_even(value, 0)",
)
def _(spark, d):
    return dedup.dedup_rounded(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"], 0)


@query(
    "dedup_across_sources",
    "SELECT text, min(id) AS id, source FROM (SELECT text, id, source, min(source) OVER (PARTITION BY text) AS s FROM"
    " (SELECT text, item_id AS id, 0 AS source FROM benchmark UNION ALL SELECT text, doc_id, 1 FROM documents))"
    " WHERE source = s GROUP BY text, source",
)
def _(spark, d):
    first = table(spark, d, "benchmark").select("text", F.col("item_id").alias("id"), F.lit(0).alias("source"))
    second = table(spark, d, "documents").select("text", F.col("doc_id").alias("id"), F.lit(1).alias("source"))
    return dedup.dedup_sources([first, second], ["text"], ["id"])


@query(
    "count_duplicate_keys",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def _(spark, d):
    return dedup.count_duplicates(table(spark, d, "lineitem"), _LINE_KEY)


@query(
    "bag_union",
    "SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer",
)
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_nationkey nation", "s_acctbal balance")
    c = table(spark, d, "customer").selectExpr("c_acctbal balance", "c_nationkey nation")
    return dedup.bag_union([s, c])


@query(
    "dedup_report",
    "SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after, count(*) - count(DISTINCT text) AS removed"
    " FROM documents",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("text")
    return dedup.removed(rows, dedup.dedup(rows, ["text"]))


# The greedy rule row by row: a row stays when it lies beyond the last kept one.
def _greedy(source: str, key: str, value: str, tie: str, width: str, columns: str) -> str:
    return f"""
    WITH RECURSIVE s AS (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}, {tie}) AS pos FROM {source}),
    r AS (
      SELECT pos, {key} AS k, {value} AS anchor, true AS keep, {tie} AS id FROM s WHERE pos = 1
      UNION ALL
      SELECT s.pos, r.k, CASE WHEN s.{value} - r.anchor > {width} THEN s.{value} ELSE r.anchor END,
             s.{value} - r.anchor > {width}, s.{tie}
      FROM r JOIN s ON s.pos = r.pos + 1 AND s.{key} = r.k)
    SELECT {columns} FROM {source} WHERE {tie} IN (SELECT id FROM r WHERE keep)
    """


@query(
    "dedup_time_window_per_user",
    _greedy("events", "user_id", "ts", "event_id", "INTERVAL 3 HOUR", "event_id, user_id, ts, value"),
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return dedup_time_window(rows, "ts", ["event_id"], 3 * 3600, ["user_id"])


# The same rule over the whole table: from each kept value to the next one beyond the width.
def _jumps(value: str, width: str, columns: str) -> str:
    return f"""
    WITH RECURSIVE r AS (
      SELECT min({value}) AS anchor FROM events
      UNION ALL
      SELECT (SELECT min(e.{value}) FROM events e WHERE e.{value} - r.anchor > {width}) FROM r WHERE anchor IS NOT NULL)
    SELECT {columns} FROM events WHERE event_id IN
      (SELECT min(event_id) FROM events JOIN r ON {value} = anchor GROUP BY {value})
    """


@query("dedup_time_window_overall", _jumps("ts", "INTERVAL 10 MINUTE", "event_id, user_id, ts, value"))
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return dedup_time_window(rows, "ts", ["event_id"], 600)


@query("dedup_numeric_tolerance", _jumps("value", "0.25::DOUBLE", "event_id, value"))
def _(spark, d):
    return dedup_tolerance(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"], 0.25)


# The same rule with chunks much smaller than the table, and a width beyond a chunk.
@query("dedup_time_window_split", _jumps("ts", "INTERVAL 10 SECOND", "event_id, ts"))
def _(spark, d):
    return dedup_time_window(table(spark, d, "events").select("event_id", "ts"), "ts", ["event_id"], 10, rows_per_chunk=700)


@query("dedup_day_window_split", _jumps("ts", "INTERVAL 1 DAY", "event_id, ts"))
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return dedup_time_window(rows, "ts", ["event_id"], 86400, rows_per_chunk=100)


# Windows of many chunks each: few rows stay, and most chunks are leapt over.
@query("dedup_wide_window_split", _jumps("ts", "INTERVAL 4 DAY", "event_id, ts"))
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return dedup_time_window(rows, "ts", ["event_id"], 4 * 86400, rows_per_chunk=100)


@query("dedup_numeric_tolerance_split", _jumps("value", "0.25::DOUBLE", "event_id, value"))
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "value")
    return dedup_tolerance(rows, "value", ["event_id"], 0.25, rows_per_chunk=700)


@query("dedup_similar_passages")
def _(spark, d):
    return dedup_fuzzy(table(spark, d, "benchmark"), "text", ["item_id"], 0.8)


# The matching-blocks ratio: the longest common block (earliest in a, then in b) splits a
# pair of ranges in two, down to ranges without one. ``run`` is the block from (i, j) on.
@query(
    "dedup_similar_names",
    """
    WITH RECURSIVE n AS MATERIALIZED (
      SELECT p_name, min(p_partkey) AS id, row_number() OVER (ORDER BY min(p_partkey)) AS pos FROM part GROUP BY 1),
    cells AS MATERIALIZED (
      SELECT x.p_name AS a, y.p_name AS b, i, j FROM n x JOIN n y ON x.pos < y.pos,
             unnest(range(1, length(x.p_name) + 1)) AS s(i), unnest(range(1, length(y.p_name) + 1)) AS t(j)
      WHERE substr(x.p_name, i, 1) = substr(y.p_name, j, 1)),
    runs AS MATERIALIZED (
      SELECT a, b, i, j, list_max([k FOR k IN range(1, 13) IF k <= length(a) - i + 1 AND k <= length(b) - j + 1
             AND substr(a, i, k) = substr(b, j, k)]) AS run FROM cells),
    parts AS (
      SELECT DISTINCT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size FROM runs
      UNION ALL
      SELECT a, b, side.alo, side.ahi, side.blo, side.bhi, side.size FROM (
        SELECT a, b, unnest([
            {'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'size': k},
            {'alo': i + k, 'ahi': ahi, 'blo': j + k, 'bhi': bhi, 'size': 0}]) AS side
        FROM (
          SELECT p.*, i, j, least(run, ahi - i, bhi - j) AS k,
                 row_number() OVER (PARTITION BY p.a, p.b, alo, blo
                   ORDER BY least(run, ahi - i, bhi - j) DESC, i, j) AS nth
          FROM parts p JOIN runs USING (a, b) WHERE i >= alo AND i < ahi AND j >= blo AND j < bhi)
        WHERE nth = 1)),
    near AS MATERIALIZED (
      SELECT a, b FROM parts GROUP BY a, b HAVING 2.0 * sum(size) / (length(a) + length(b)) >= 0.75),
    r AS (
      SELECT 0::BIGINT AS pos, []::VARCHAR[] AS kept
      UNION ALL
      SELECT n.pos, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.b = n.p_name AND list_contains(r.kept, near.a))
             THEN r.kept ELSE list_append(r.kept, n.p_name) END
      FROM r JOIN n ON n.pos = r.pos + 1)
    SELECT id AS p_partkey, p_name FROM n
    WHERE list_contains((SELECT kept FROM r ORDER BY pos DESC LIMIT 1), p_name)
    """,
)
def _(spark, d):
    return dedup_fuzzy(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"], 0.75)


@query(
    "dedup_names_by_edits",
    """
    WITH RECURSIVE n AS (
      SELECT p_name, min(p_partkey) AS id, row_number() OVER (ORDER BY min(p_partkey)) AS pos FROM part GROUP BY p_name),
    r AS (
      SELECT pos, [p_name] AS kept FROM n WHERE pos = 1
      UNION ALL
      SELECT n.pos, CASE WHEN len(list_filter(r.kept, lambda k: 1 - levenshtein(k, n.p_name)::DOUBLE
             / greatest(length(k), length(n.p_name)) >= 0.75)) > 0 THEN r.kept ELSE list_append(r.kept, n.p_name) END
      FROM r JOIN n ON n.pos = r.pos + 1)
    SELECT id AS p_partkey, p_name FROM n
    WHERE list_contains((SELECT kept FROM r ORDER BY pos DESC LIMIT 1), p_name)
    """,
)
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return dedup_fuzzy(rows, "p_name", ["p_partkey"], 0.75, metric="levenshtein")


@query(
    "dedup_cosine_documents",
    """
    WITH RECURSIVE tok AS (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS t FROM documents),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY 1, 2),
    idf AS (SELECT t, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS w FROM tf GROUP BY 1),
    raw AS (SELECT doc_id, tf.t, tf * w AS x FROM tf JOIN idf USING (t)),
    vec AS MATERIALIZED (SELECT doc_id, t, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM raw),
    pairs AS MATERIALIZED (
      SELECT a, b, row_number() OVER (ORDER BY a, b) AS pos FROM (
        SELECT v.doc_id AS a, u.doc_id AS b FROM vec v JOIN vec u ON v.t = u.t AND v.doc_id < u.doc_id
        GROUP BY 1, 2 HAVING sum(v.x * u.x) >= 0.85)),
    r AS (
      SELECT 0::BIGINT AS pos, []::BIGINT[] AS gone
      UNION ALL
      SELECT p.pos, CASE WHEN list_contains(r.gone, p.a) THEN r.gone ELSE list_append(r.gone, p.b) END
      FROM r JOIN pairs p ON p.pos = r.pos + 1)
    SELECT doc_id, lang, n_chars FROM documents
    WHERE NOT list_contains((SELECT gone FROM r ORDER BY pos DESC LIMIT 1), doc_id)
    """,
)
def _(spark, d):
    out = dedup_cosine(table(spark, d, "documents"), "text", ["doc_id"], 0.85)
    return out.select("doc_id", "lang", "n_chars")
