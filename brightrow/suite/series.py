"""Ordered rows: rolling means, interpolation, forward fill, resampling."""

from pyspark.sql import functions as F

from brightrow.operators import windows
from brightrow.operators.timeseries import resample_mean
from brightrow.session import durable
from brightrow.suite.registry import SQL, query, rounded, table
from brightrow.suite.strings import NULLED_EVENTS, nulled_events


@query(
    "rolling_mean_per_user",
    "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id"
    f" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "user_id", "ts", "value")
    out = windows.smooth(rows, ["value"], ["ts", "event_id"], 3, ["user_id"])
    return rounded(out.drop("ts"), "value")


@query(
    "rolling_mean_overall",
    "SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6)"
    f" AS value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "ts", "value")
    return rounded(windows.smooth(rows, ["value"], ["ts", "event_id"], 5).drop("ts"), "value")


_INTERPOLATED = """
  WITH p AS (SELECT event_id, user_id, value, row_number() OVER ({w}) AS pos FROM ({src})),
  q AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY {k} ORDER BY pos) AS a,
               min(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY {k} ORDER BY pos
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
  SELECT q.event_id, round(CASE WHEN q.a IS NULL THEN NULL WHEN q.b IS NULL OR q.a = q.b THEN x.value
         ELSE x.value + (y.value - x.value) * ((q.pos - q.a) / (q.b - q.a)) END, 6) AS value
  FROM q LEFT JOIN p x ON {jx} AND x.pos = q.a LEFT JOIN p y ON {jy} AND y.pos = q.b
"""


@query(
    "interpolate_per_user",
    _INTERPOLATED.format(
        w="PARTITION BY user_id ORDER BY ts, event_id",
        k="user_id",
        src=NULLED_EVENTS,
        jx="x.user_id = q.user_id",
        jy="y.user_id = q.user_id",
    ),
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "user_id", "ts", "value")
    out = windows.interpolate(rows, ["value"], ["ts", "event_id"], ["user_id"])
    return rounded(out.select("event_id", "value"), "value")


@query(
    "interpolate_overall",
    _INTERPOLATED.format(w="ORDER BY ts, event_id", k="1", src=NULLED_EVENTS, jx="true", jy="true"),
)
def _(spark, d):
    rows = nulled_events(spark, d).select("event_id", "ts", "value")
    return rounded(windows.interpolate(rows, ["value"], ["ts", "event_id"]).drop("ts"), "value")


@query(
    "forward_fill",
    "SELECT event_id, user_id, last_value(event_type IGNORE NULLS) OVER w AS event_type,"
    f" last_value(value IGNORE NULLS) OVER w AS value FROM ({NULLED_EVENTS})"
    " WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def _(spark, d):
    out = windows.ffill(nulled_events(spark, d), ["event_type", "value"], ["ts", "event_id"], ["user_id"])
    return out.drop("ts")


@query(
    "unique_suffixes",
    "SELECT p_partkey, CASE WHEN n = 0 THEN p_name ELSE concat(p_name, '_', n) END AS p_name FROM (SELECT p_partkey,"
    " p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)",
)
def _(spark, d):
    return windows.enforce_unique(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])


_HOURLY = """
  WITH b AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
  g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY 1)
  SELECT g.event_type, g.ts, round(b.value, 6) AS value FROM g LEFT JOIN b USING (event_type, ts)
"""


@query("resample_hourly_per_type", _HOURLY)
def _(spark, d):
    out = resample_mean(table(spark, d, "events"), "ts", "1h", ["value"], ["event_type"])
    return rounded(out, "value")


@query(
    "resample_five_minutes",
    """
    WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ts, avg(user_id) AS user_id, avg(value) AS value
               FROM events GROUP BY 1),
    g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 5 MINUTE)) AS ts FROM b)
    SELECT g.ts, round(b.user_id, 6) AS user_id, round(b.value, 6) AS value FROM g LEFT JOIN b USING (ts)
    """,
)
def _(spark, d):
    rows = table(spark, d, "events").select("ts", "event_type", "user_id", "value")
    return rounded(resample_mean(rows, "ts", "5min"), "user_id", "value")


@query(
    "event_log_report",
    """
    WITH e AS (
      SELECT event_id, ts, user_id, lower(trim(event_type)) AS event_type, value,
             CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
    s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM e),
    x AS (SELECT e.* FROM e, s WHERE abs((value - m) / s) <= 3),
    f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) = 1),
    b AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value, avg(k) AS k FROM f GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY 1),
    r AS (SELECT g.event_type, g.ts, b.value, b.k FROM g LEFT JOIN b USING (event_type, ts))
    SELECT event_type, ts, round(avg(value) OVER w, 6) AS value, round(avg(k) OVER w, 6) AS k FROM r
    WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
    """,
)
def _(spark, d):
    """Parse, tidy, drop outliers and repeats, hourly means per type, smoothed and sorted."""
    from brightrow.operators import dedup, nested, project, scaling, strings

    events = nested.parse_json(table(spark, d, "events"), "props", "k bigint")
    events = events.withColumn("k", F.col("props.k")).drop("props")
    tidy = strings.lower(strings.trim(events, ["event_type"]), ["event_type"])
    usual = scaling.remove_outliers(tidy, ["value"])
    once = dedup.dedup_first(usual, ["user_id", "event_type", "ts"], ["event_id"])
    # Few rows from here on, which smoothing and sorting each go through again.
    hourly = durable(resample_mean(once, "ts", "1h", ["value", "k"], ["event_type"]))
    smooth = windows.smooth(hourly, ["value", "k"], ["ts"], 3, ["event_type"])
    return project.sort_by(rounded(smooth, "value", "k"), ["event_type", "ts"])


# The same operators with keys split over chunks of a few hundred rows, against the same SQL.
CHUNK_ROWS = 300


def _split(name: str, fn) -> None:
    query(f"{name}_split", SQL[name])(fn)


def _smooth_overall(spark, d):
    rows = nulled_events(spark, d).select("event_id", "ts", "value")
    return rounded(windows.smooth(rows, ["value"], ["ts", "event_id"], 5, rows_per_chunk=CHUNK_ROWS).drop("ts"), "value")


def _interpolate_overall(spark, d):
    rows = nulled_events(spark, d).select("event_id", "ts", "value")
    out = windows.interpolate(rows, ["value"], ["ts", "event_id"], rows_per_chunk=CHUNK_ROWS)
    return rounded(out.drop("ts"), "value")


def _unique_suffixes(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return windows.enforce_unique(rows, "p_name", ["p_partkey"], rows_per_chunk=20)


_split("rolling_mean_overall", _smooth_overall)
_split("interpolate_overall", _interpolate_overall)
_split("unique_suffixes", _unique_suffixes)


@query(
    "rolling_mean_per_type_split",
    "SELECT event_id, round(1e-8 + avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id"
    f" ROWS BETWEEN 300 PRECEDING AND CURRENT ROW), 6) AS value FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    """A window wider than a chunk. The small summand keeps means off the borders of rounding."""
    rows = nulled_events(spark, d).select("event_id", "event_type", "ts", "value")
    out = windows.smooth(rows, ["value"], ["ts", "event_id"], 301, ["event_type"], rows_per_chunk=200)
    return rounded(out.select("event_id", (F.col("value") + 1e-8).alias("value")), "value")


@query(
    "forward_fill_split",
    "SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS value"
    f" FROM ({NULLED_EVENTS})",
)
def _(spark, d):
    rows = nulled_events(spark, d).withColumn("part", F.col("user_id") % 3)
    out = windows.ffill(rows, ["value"], ["ts", "event_id"], ["part"], rows_per_chunk=CHUNK_ROWS)
    return out.select("event_id", "value")
