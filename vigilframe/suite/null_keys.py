"""The keyed operators over keys that are NULL: NULL is a key like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import history as H
from vigilframe.operators import outliers
from vigilframe.plans import workload as W
from vigilframe.suite.base import query

_QUARTILES = """SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM {fx_null_events} GROUP BY event_type"""


@query(
    "e7_run_gaps_null_keys",
    """SELECT user_id, history_id, executed_at, previous_executed_at,
         date_sub('second', previous_executed_at, executed_at) AS gap_seconds
       FROM (SELECT user_id, event_id AS history_id, ts AS executed_at, lag(ts) OVER (PARTITION BY user_id
               ORDER BY ts, event_id) AS previous_executed_at FROM {fx_null_events})""",
)
def _(t):
    runs = t.fx_null_events.withColumnsRenamed({"event_id": "history_id", "ts": "executed_at"})
    return H.run_gaps(runs, ["user_id"])


@query(
    "e8_share_null_keys",
    """SELECT event_type, user_id, cnt,
         round(cnt * 100.0E0 / sum(cnt) OVER (PARTITION BY event_type), 4) AS share_pct
       FROM (SELECT event_type, user_id, count(*) AS cnt FROM {fx_null_events} GROUP BY 1, 2)""",
)
def _(t):
    counts = t.fx_null_events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("cnt"))
    return H.with_share(counts, ["event_type"], "cnt")


@query(
    "x1_zscore_null_keys",
    """SELECT event_type, event_id, value, round(z, 6) AS z_score FROM (
         SELECT event_type, event_id, value, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z
         FROM {fx_null_events} WINDOW w AS (PARTITION BY event_type)) WHERE abs(z) > 3""",
)
def _(t):
    return outliers.zscore_outliers(t.fx_null_events, ["event_type"], "event_id", "value")


@query(
    "x2_iqr_null_keys",
    f"""SELECT e.event_type, event_id, value FROM {{fx_null_events}} e JOIN ({_QUARTILES}) q
          ON e.event_type IS NOT DISTINCT FROM q.event_type
        WHERE value < q1 - 1.5E0 * (q3 - q1) OR value > q3 + 1.5E0 * (q3 - q1)""",
)
def _(t):
    return outliers.iqr_outliers(t.fx_null_events, ["event_type"], "event_id", "value")


@query(
    "x5_adaptive_null_keys",
    """SELECT event_type, event_id, value FROM (
         SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n
         FROM {fx_null_events} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
           ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
       WHERE n = 24 AND abs(value - m) > 3 * s""",
)
def _(t):
    hits = outliers.adaptive_threshold(t.fx_null_events, ["event_type"], ["ts", "event_id"], "value")
    return hits.select("event_type", "event_id", "value")


@query(
    "m27_change_history_null_keys",
    """SELECT user_id, event_id, ts, event_type, previous_type FROM (SELECT *, lag(event_type) OVER (
         PARTITION BY user_id ORDER BY ts, event_id) AS previous_type FROM {fx_null_events})
       WHERE previous_type <> event_type""",
)
def _(t):
    return W.change_history(t.fx_null_events)
