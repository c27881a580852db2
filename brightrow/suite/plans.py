"""Cleaning plans over rows in the shape each kind of source delivers."""

from pyspark.sql import functions as F

from brightrow.plans import cleaning
from brightrow.suite.registry import query, rounded, table

_PLAIN = "regexp_replace(lower(trim({c})), '[^0-9a-z\\s]', '', 'g')"


def _clean(c: str) -> str:
    return _PLAIN.format(c=c)


def _within(source: str, cols: list[str], z: float, first: str = "x0") -> str:
    """CTE chain that drops outliers column after column; the last step is named ``kept``."""
    steps, before = [f"{first} AS ({source})"], first
    for i, c in enumerate(cols):
        after = "kept" if i == len(cols) - 1 else f"x{i + 1}"
        steps.append(f"m{i} AS (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {before})")
        steps.append(f"{after} AS (SELECT {before}.* FROM {before}, m{i} WHERE abs(({c} - m) / s) <= {z})")
        before = after
    return "WITH " + ", ".join(steps)


def _accounts(spark, d):
    """Customer rows as untidy text, every row twice."""
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit("! ")).alias("name"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("status"),
        F.abs(F.floor("c_acctbal")).cast("string").alias("score"),
        F.lit("1998-05-06").alias("joined"),
    )
    return rows.unionByName(rows)


_ACCOUNTS = f"""
  SELECT c_custkey AS id, {_clean('c_name')} AS name, CAST(abs(floor(c_acctbal)) AS BIGINT) AS score,
         CASE WHEN c_custkey % 11 <> 0 THEN lower(c_mktsegment) ELSE '' END AS status
  FROM customer
"""


@query(
    "plan_csv",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + " SELECT id AS key, name, score, TIMESTAMP '1998-05-06' AS joined, upper(CASE status WHEN 'building' THEN 'site'"
    " ELSE regexp_replace(status, 'ery$', '', 'g') END) AS status FROM kept",
)
def _(spark, d):
    rows = _accounts(spark, d).withColumn("joined", F.lit("19980506"))
    out = cleaning.clean(
        rows,
        "csv",
        subset=["id"],
        order_by=["name"],
        mappings={"status": {"building": "site"}},
        regex_map={"status": "ery$"},
        rename_map={"id": "key"},
        date_columns=["joined"],
        z=1.5,
    ).data
    return out.withColumn("joined", F.col("joined").cast("timestamp_ntz"))


@query(
    "plan_json",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + ' SELECT id AS "person_id", name AS "person_name", score, CASE upper(status) WHEN \'BUILDING\' THEN \'SITE\''
    " ELSE upper(status) END AS status FROM kept",
)
def _(spark, d):
    rows = _accounts(spark, d).select(F.struct("id", "name").alias("person"), "score", "status")
    return cleaning.clean(rows, "json", replace_map={"BUILDING": "SITE"}, z=1.5).data


@query(
    "plan_records_encoded",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + """ SELECT id, score, status = 'building' AS "status_BUILDING", status = 'furniture' AS "status_FURNITURE",
        status = 'household' AS "status_HOUSEHOLD", status = 'machinery' AS "status_MACHINERY" ,
        status = 'automobile' AS "status_AUTOMOBILE" FROM kept""",
)
def _(spark, d):
    rows = _accounts(spark, d).select("id", "score", "status")
    return cleaning.clean(rows, "xml", categorical_columns=["status"], z=1.5).data


@query(
    "plan_sheets",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + " SELECT id, score, 'plain' AS sheet FROM kept UNION ALL SELECT id, score, 'wide' FROM"
    " (SELECT c_custkey AS id, CAST(abs(floor(c_acctbal)) AS BIGINT) AS score FROM customer)",
)
def _(spark, d):
    rows = _accounts(spark, d).select("id", "score")
    sheets = cleaning.clean_sheets(
        {"plain": rows, "wide": rows}, options={"plain": {"z": 1.5}, "wide": {"z": 100.0}}
    )
    return sheets["plain"].withColumn("sheet", F.lit("plain")).unionByName(
        sheets["wide"].withColumn("sheet", F.lit("wide"))
    )


@query(
    "plan_html",
    _within(_ACCOUNTS, ["id", "score"], 1.5) + " SELECT id, name, score, upper(status) AS status FROM kept",
)
def _(spark, d):
    rows = _accounts(spark, d).select(
        "id", F.concat(F.lit("<b>"), "name", F.lit("</b>")).alias("name"), "score", "status"
    )
    return cleaning.clean(rows, "html", z=1.5).data


@query(
    "plan_parquet_scaled",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + " SELECT id, name, upper(status) AS status, round((score - min(score) OVER ()) / (max(score) OVER () -"
    " min(score) OVER ()), 6) AS score FROM kept",
)
def _(spark, d):
    rows = _accounts(spark, d).drop("joined")
    out = cleaning.clean(rows, "parquet", minmax=True, scale_columns=["score"], z=1.5).data
    return rounded(out, "score")


@query(
    "plan_orc_standard",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + " SELECT id, name, upper(status) AS status, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6)"
    " AS score FROM kept",
)
def _(spark, d):
    rows = _accounts(spark, d).drop("joined")
    out = cleaning.clean(rows, "orc", standard=True, scale_columns=["score"], z=1.5).data
    return rounded(out, "score")


@query(
    "plan_workbook",
    "SELECT event_id, lower(last_value(k IGNORE NULLS) OVER (ORDER BY event_id)) AS kind FROM (SELECT event_id,"
    " CASE WHEN event_id % 3 = 0 THEN event_type END AS k FROM events)",
)
def _(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper("event_type")))
    rows = table(spark, d, "events").select("event_id", kind.alias("Kind "))
    return cleaning.clean(rows, "workbook", order_by=["event_id"]).data


@query(
    "plan_log",
    """
    SELECT DISTINCT upper(event_type) AS level, concat('event ', event_id, ' of user ', user_id) AS message,
           strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS timestamp, CAST(user_id AS VARCHAR) AS who
    FROM events WHERE user_id % 10 <> 3
    """,
)
def _(spark, d):
    rows = table(spark, d, "events").select(
        F.concat(F.lit(" "), "event_type").alias("level"),
        F.concat(F.lit("Event #"), "event_id", F.lit(" of user "), "user_id", F.lit("!")).alias("message"),
        F.concat(F.lit("d:"), F.date_format("ts", "yyyyMMdd")).alias("timestamp"),
    )
    # The tidied stamp is the letter d and eight digits.
    out = cleaning.clean(
        rows,
        "log",
        date_format="'d'yyyyMMdd",
        remove_keywords=["user \\d*3$"],
        regex_fields={"who": r"user (?P<who>\d+)"},
    ).data
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


_SERIES = """
  WITH b AS (SELECT date_trunc('hour', ts) AS ts, avg(CASE WHEN hour(ts) % 4 <> 1 THEN value END) AS value,
                    avg(CASE WHEN hour(ts) % 4 <> 1 THEN user_id END) AS user_id FROM events GROUP BY 1),
  g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b),
  p AS (SELECT g.ts, b.value, b.user_id, row_number() OVER (ORDER BY g.ts) AS pos FROM g LEFT JOIN b USING (ts)),
  q AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (ORDER BY pos) AS a,
               min(CASE WHEN value IS NOT NULL THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z
        FROM p),
  i AS (SELECT q.ts,
               CASE WHEN q.z IS NULL OR q.a = q.z THEN x.value ELSE x.value + (y.value - x.value) * ((q.pos - q.a) / (q.z - q.a)) END AS value,
               CASE WHEN q.z IS NULL OR q.a = q.z THEN x.user_id ELSE x.user_id + (y.user_id - x.user_id) * ((q.pos - q.a) / (q.z - q.a)) END AS user_id
        FROM q LEFT JOIN p x ON x.pos = q.a LEFT JOIN p y ON y.pos = q.z),
  m0 AS (SELECT avg(user_id) AS m, stddev_pop(user_id) AS s FROM i),
  x1 AS (SELECT i.* FROM i, m0 WHERE abs((user_id - m) / s) <= 2),
  m1 AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM x1),
  kept AS (SELECT x1.* FROM x1, m1 WHERE abs((value - m) / s) <= 2)
"""


def _readings(spark, d):
    """Events without values in every fourth hour."""
    known = F.hour("ts") % 4 != 1
    return table(spark, d, "events").select(
        "ts", F.when(known, F.col("user_id")).alias("user_id"), F.when(known, F.col("value")).alias("value"), "event_type"
    )


@query(
    "plan_sensor",
    _SERIES
    + "SELECT ts, round(avg(user_id) OVER w, 6) AS user_id, round(avg(value) OVER w, 6) AS value FROM kept"
    " WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
def _(spark, d):
    out = cleaning.clean(_readings(spark, d), "sensor", ts_col="ts", freq="1h", z=2.0).data
    return rounded(out, "user_id", "value")


@query(
    "plan_kafka",
    _SERIES
    + "SELECT ts, round(avg(user_id) OVER w, 6) AS user_id, round(avg(value * 10) OVER w, 6) AS value,"
    " CAST(NULL AS DOUBLE) AS humidity FROM kept WINDOW w AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    " ORDER BY ts LIMIT 100",
)
def _(spark, d):
    out = cleaning.clean(
        _readings(spark, d),
        "kafka",
        ts_col="ts",
        freq="1h",
        z=2.0,
        scale_map={"value": 10.0},
        required_columns=["humidity"],
        smooth_window=5,
        max_rows=100,
    ).data
    return rounded(out, "user_id", "value")


def _doc_rows(spark, d):
    doc = F.struct(
        F.struct(F.concat(F.lit(" s-"), "user_id").alias("id"), F.col("event_type").alias("status")).alias("sensor"),
        F.struct(
            F.floor("value").cast("string").alias("temperature"),
            F.when(F.col("event_id") % 4 != 0, "45").alias("humidity"),
        ).alias("metrics"),
        F.array(F.lit("a!"), F.lit("b")).alias("tags"),
    )
    return table(spark, d, "events").select("event_id", F.to_json(doc).alias("doc"))


@query(
    "plan_yaml_documents",
    """
    SELECT event_id, concat('S', user_id) AS "sensor.id", upper(event_type) AS "sensor.status",
           CAST(floor(value) AS BIGINT) AS "metrics.temperature",
           CASE WHEN event_id % 4 <> 0 THEN 45::BIGINT END AS "metrics.humidity", 'A' AS "tags[0]", 'B' AS "tags[1]"
    FROM events
    """,
)
def _(spark, d):
    return cleaning.clean_documents(_doc_rows(spark, d), "event_id", "doc").data


def _media(spark, d):
    """Media metadata as text, from the parts."""
    return table(spark, d, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit("_"), "p_partkey", F.lit(".mp4")).alias("filename"),
        F.concat(F.col("p_size") * 16, F.lit(" x "), F.col("p_size") * 9).alias("resolution"),
        F.concat(F.lit("0:"), F.col("p_size"), F.lit(":30")).alias("duration"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string")).alias("frame_rate"),
        F.col("p_partkey").alias("seq"),
    )


_MEDIA_NAME = "upper(regexp_replace(concat(p_name, '_', p_partkey, '.mp4'), '[^0-9a-zA-Z\\s]', '', 'g'))"


@query(
    "plan_video",
    _within(
        f"SELECT {_MEDIA_NAME} AS filename, concat(p_size * 16, p_size * 9) AS resolution,"
        " (p_size * 60 + 30)::DOUBLE AS duration, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS frame_rate,"
        " p_partkey AS seq FROM part",
        ["duration", "frame_rate"],
        1.5,
    )
    + " SELECT filename, resolution, round(avg(duration) OVER w, 6) AS duration, round(avg(frame_rate * 2.0) OVER w, 6)"
    " AS frame_rate, seq FROM kept WINDOW w AS (ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
def _(spark, d):
    out = cleaning.clean(
        _media(spark, d), "video", z=1.5, keys=["seq"], order_by=["seq"], scale_map={"frame_rate": 2.0}
    ).data
    return rounded(out, "duration", "frame_rate")


@query(
    "plan_audio",
    f"""
    SELECT {_MEDIA_NAME} AS filename, CAST(p_size AS BIGINT) AS bitrate, CAST(NULL AS DOUBLE) AS channels,
           round(avg(p_size * 60.0 + 30) OVER (ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS duration,
           p_partkey AS seq
    FROM part ORDER BY seq LIMIT 50
    """,
)
def _(spark, d):
    rows = _media(spark, d).select(
        "filename", (F.split("duration", ":")[1]).alias("bitrate"), F.expr("split(duration, ':')[1] * 60 + 30")
        .cast("string").alias("duration"), "seq",
    )
    out = cleaning.clean(
        rows, "audio", z=100.0, keys=["seq", "bitrate"], order_by=["seq"], required_columns=["channels"], max_rows=50
    ).data
    return rounded(out, "duration")


@query(
    "plan_image",
    _within(
        f"SELECT {_MEDIA_NAME} AS filename, p_size * 16 AS width, p_size * 9 AS height,"
        " TIMESTAMP '2024-03-01' AS timestamp, p_partkey AS seq FROM part",
        ["width", "height"],
        1.5,
    )
    + " SELECT filename, round(avg(width) OVER w, 6) AS width, round(avg(height) OVER w, 6) AS height, timestamp, seq"
    " FROM kept WINDOW w AS (ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
def _(spark, d):
    rows = _media(spark, d).select(
        "filename",
        F.split("resolution", " x ")[0].alias("width"),
        F.split("resolution", " x ")[1].alias("height"),
        F.lit("d20240301").alias("timestamp"),
        "seq",
    )
    out = cleaning.clean(
        rows, "image", z=1.5, keys=["seq"], order_by=["seq"], date_format="'D'yyyyMMdd"
    ).data
    out = out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return rounded(out, "width", "height")


@query(
    "clean_table_end_to_end",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + " SELECT status, min(id) AS id FROM kept GROUP BY status",
)
def _(spark, d):
    rows = _accounts(spark, d).select("id", "status", "score")
    done = cleaning.clean_table(
        rows,
        "json",
        rules={"score": {"min": 0}, "status": {"allowed": ["building"]}},
        strategy="first",
        columns=["status"],
        order_by=["id"],
        z=1.5,
    )
    if done.errors:
        raise RuntimeError(done.errors)
    return done.data.select("status", "id")


@query(
    "rule_report_of_clean_table",
    _within(_ACCOUNTS, ["id", "score"], 1.5)
    + " SELECT 'score' AS column, 'range' AS rule, count(*) FILTER (score < 0) AS invalid_count, 'pass' AS status FROM kept"
    " UNION ALL SELECT 'status', 'allowed', count(*) FILTER (status <> 'building'), 'fail' FROM kept",
)
def _(spark, d):
    rows = _accounts(spark, d).select("id", "status", "score")
    rules = {"score": {"min": 0}, "status": {"allowed": ["building"]}}
    return cleaning.clean_table(rows, "json", rules=rules, strategy=None, z=1.5).validation
