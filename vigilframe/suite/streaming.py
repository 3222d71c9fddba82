"""Streaming jobs (J) compared with their batch meaning over closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.fixtures import PRIMARY_KEYS, TABLE_COLUMNS, TEXT_COLUMNS
from vigilframe.plans.skew import ROWS_PER_TASK
from vigilframe.streaming import jobs as J
from vigilframe.suite.base import query
from vigilframe.suite.quality import _counts, _scan_sql

HOURLY = """SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start,
    CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL '1' HOUR AS window_end, count(*) AS n,
    round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2, 3"""
CLOSED = "window_end <= (SELECT max(ts) FROM {events}) - INTERVAL '10' MINUTE"


def event_stream(t):
    return J.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


@query("j1_hourly_metric_batch", HOURLY)
def _(t):
    return J.windowed_metric(J.with_event_time(t.events))


@query("j1_hourly_metric_stream", f"SELECT * FROM ({HOURLY}) WHERE {CLOSED}")
def _(t):
    out, checkpoint = J.paths(t.spark, "hourly", "out", "checkpoint")
    J.run_to_table(J.windowed_metric(J.with_event_time(event_stream(t))), out, checkpoint)
    return t.spark.read.parquet(out)


# Thresholds of the streamed metrics.
_LIMITS = {"view": (">", 5.0), "error": (">=", 4.0), "purchase": ("<", 2.0), "click": ("==", 3.0)}


def _run_history(t):
    history, anomalies, checkpoint = J.paths(t.spark, "tick", "history", "anomalies", "checkpoint")
    limits = ", ".join(f"('{k}', '{op}', {v}E0)" for k, (op, v) in _LIMITS.items())
    settings = t.sql(f"SELECT * FROM (VALUES {limits}) AS s(metric_id, threshold_operator, threshold_value)")
    J.history_and_anomalies(event_stream(t), settings, history, anomalies, checkpoint)
    return t.spark.read.parquet(history).drop("batch"), t.spark.read.parquet(anomalies).drop("batch")


@query(
    "j2_history_stream",
    f"""SELECT event_type AS metric_id, window_end AS executed_at, CAST(n AS DOUBLE) AS result_value
        FROM ({HOURLY}) WHERE {CLOSED}""",
)
def _(t):
    return _run_history(t)[0]


@query(
    "j2_anomaly_stream",
    f"""SELECT event_type AS metric_id, window_end AS detected_at,
          CASE WHEN op = '<' THEN 'threshold_below' ELSE 'threshold_exceeded' END AS anomaly_type,
          v AS threshold_value, CAST(n AS DOUBLE) AS actual_value
        FROM ({HOURLY}) JOIN (VALUES {', '.join(f"('{k}', '{op}', {v}E0)" for k, (op, v) in _LIMITS.items())})
          AS s(k, op, v) ON k = event_type
        WHERE {CLOSED} AND CASE op WHEN '>' THEN n > v WHEN '>=' THEN n >= v WHEN '<' THEN n < v
          WHEN '==' THEN n = v END""",
)
def _(t):
    return _run_history(t)[1]


@query(
    "j3_sliding_orders",
    """SELECT event_type, window_start, window_start + INTERVAL '1' HOUR AS window_end, count(*) AS n,
         round(sum(value), 4) AS total
       FROM (SELECT event_type, value, time_bucket(INTERVAL '5' MINUTE, ts) - s * INTERVAL '5' MINUTE AS window_start
             FROM {events}, (SELECT unnest(range(12)) AS s) WHERE event_type = 'purchase') GROUP BY 1, 2""",
)
def _(t):
    orders = t.events.where(F.col("event_type") == "purchase")
    return J.windowed_metric(J.with_event_time(orders), "1 hour", "5 minutes")


SESSIONS = """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30' MINUTE AS session_end,
    count(*) AS steps FROM (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
        + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS is_new FROM {events})) GROUP BY user_id, s"""


@query("j4_session_activity_batch", SESSIONS)
def _(t):
    return J.session_activity(J.with_event_time(t.events))


@query(
    "j4_session_activity_stream",
    f"""SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) FROM {{events}}) - INTERVAL '10' MINUTE""",
)
def _(t):
    out, checkpoint = J.paths(t.spark, "sessions", "out", "checkpoint")
    J.run_to_table(J.session_activity(J.with_event_time(event_stream(t))), out, checkpoint)
    return t.spark.read.parquet(out)


@query(
    "j5_late_rows_dropped",
    f"""SELECT * FROM ({HOURLY}) WHERE event_type <> 'signup'
        AND window_end <= (SELECT max(ts) FROM {{events}}) - INTERVAL '10' MINUTE""",
)
def _(t):
    """Signups arrive in a second run, after the watermark has passed them, and are dropped."""
    source, out, checkpoint = J.paths(t.spark, "late", "in", "out", "checkpoint")
    late = F.col("event_type") == "signup"
    for arriving in (~late, late):
        t.events.where(arriving).write.mode("append").parquet(source)
        stream = J.file_stream(t.spark, source, t.events.schema)
        J.run_to_table(J.windowed_metric(J.with_event_time(stream)), out, checkpoint)
    return t.spark.read.parquet(out)


def _scanned(t, table: str, key: list[str] = [], compact_every: int = 8):  # noqa: B006
    """State after ``table`` arrived in four batches, of so many files each that a task holds a bounded part."""
    source, root, checkpoint = J.paths(t.spark, table, "in", "state", "checkpoint")
    df = getattr(t, table)
    files = -(-df.count() // (4 * ROWS_PER_TASK)) or 1
    df.repartition(4 * files).write.parquet(source)
    stream = J.file_stream(t.spark, source, df.schema, files_per_batch=files)
    J.incremental_scan(stream, root, checkpoint, key, compact_every)
    return J.ScanState(t.spark, root, df.schema, key, compact_every)


_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_records, count(*) - count({c}) AS null_count FROM {{fx_nulls}}"
    for c in ["o_orderkey", "n50", "n8", "n3", "n05"]
)


@query("j6_incremental_null_profile", _NULLS)
def _(t):
    return _scanned(t, "fx_nulls").merged("nulls")


@query("j6_incremental_categories", _counts("{orders}", TEXT_COLUMNS["orders"]))
def _(t):
    return _scanned(t, "orders").merged("categories")


@query(
    "j6_incremental_rollup",
    f"""SELECT *, CASE WHEN anomaly_count * 10 >= total_records THEN 'error'
          WHEN anomaly_count * 20 >= total_records THEN 'warning'
          WHEN anomaly_count * 100 >= total_records THEN 'info' ELSE 'normal' END AS status
        FROM (SELECT *, null_count + distribution_count AS anomaly_count FROM (
          SELECT 'fx_nulls' AS table_name, max(total_records) AS total_records,
            CAST(sum(CASE WHEN null_count = 0 THEN 0 WHEN null_count * 20 < total_records THEN 1
              WHEN null_count * 5 < total_records THEN 0 ELSE 1 END) AS BIGINT) AS null_count,
            (SELECT count(*) FROM ({_counts('{fx_nulls}', ['n50', 'n8', 'n3', 'n05'])}) c
             WHERE value IS NOT NULL AND cnt * 20 < (SELECT count(*) FROM {{fx_nulls}})) AS distribution_count
          FROM ({_NULLS})))""",
)
def _(t):
    return _scanned(t, "fx_nulls").roll_up("fx_nulls").drop("duplicate_count")


@query(
    "j6_incremental_scan_lineitem",
    _scan_sql("{lineitem}", TABLE_COLUMNS["lineitem"], TEXT_COLUMNS["lineitem"], PRIMARY_KEYS["lineitem"]),
)
def _(t):
    """Scanned batch by batch, the table gives the row of the full scan."""
    return _scanned(t, "lineitem", PRIMARY_KEYS["lineitem"], 3).roll_up("lineitem")


@query("j6_incremental_scan_repeated_keys", _scan_sql("{fx_null_keys}", ["a", "b"], [], ["a", "b"]))
def _(t):
    """Keys that repeat within and across batches, with NULL parts."""
    return _scanned(t, "fx_null_keys", ["a", "b"], 2).roll_up("fx_null_keys")


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@query(
    "j6_incremental_scan_not_null",
    _scan_sql("{fx_null_events}", _EVENT_COLUMNS, ["event_type"], ["user_id"], ("user_id", "ts")),
)
def _(t):
    """Declared NOT NULL columns score by rows, and NULLs of a one-column key count as surplus."""
    return _scanned(t, "fx_null_events", ["user_id"]).roll_up("fx_null_events", ["user_id", "ts"])


# --- categorical results of a stream ------------------------------------------------------

_DAYS = """SELECT window_start, window_start + INTERVAL '1' DAY AS window_end, label, cnt,
      CAST(sum(cnt) OVER (PARTITION BY window_start) AS BIGINT) AS run_total
    FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CASE WHEN event_id % 250 = 0 THEN 'rare'
            WHEN event_id % 40 = 1 THEN 'minor' ELSE event_type END AS label, count(*) AS cnt FROM {events} GROUP BY 1, 2)"""


def _labelled(events):
    rare = F.when(F.col("event_id") % 250 == 0, "rare").when(F.col("event_id") % 40 == 1, "minor")
    return events.withColumn("label", rare.otherwise(F.col("event_type")))


def _run_categories(t):
    results, anomalies, checkpoint = J.paths(t.spark, "shares", "results", "anomalies", "checkpoint")
    J.categorical_history(_labelled(event_stream(t)), "label", "1 day", results, anomalies, checkpoint)
    return t.spark.read.parquet(results).drop("batch"), t.spark.read.parquet(anomalies).drop("batch")


@query("j2_category_results_batch", _DAYS)
def _(t):
    return J.category_shares(J.with_event_time(_labelled(t.events)), "label", "1 day")


@query("j2_category_results_stream", f"SELECT * FROM ({_DAYS}) WHERE {CLOSED}")
def _(t):
    """Counts per label and totals per day, both aggregated and joined in the stream."""
    return _run_categories(t)[0]


@query(
    "j2_categorical_anomaly_stream",
    f"""SELECT window_end AS detected_at, 'threshold_exceeded' AS anomaly_type, 5.0E0 AS threshold_value,
          CAST(count(*) AS DOUBLE) AS actual_value
        FROM ({_DAYS}) WHERE {CLOSED} AND cnt >= 1 AND cnt * 20 < run_total GROUP BY window_end""",
)
def _(t):
    """Days with rare categories, found in the stream as T7 finds them in a batch."""
    return _run_categories(t)[1]
