"""History windows (E), time ranges (B6, B14), gaps (D19), trend and thresholds (X3-X5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.fixtures import NOW, TODAY
from vigilframe.functions.scalars import ntz, on_day
from vigilframe.operators import history as H
from vigilframe.operators import outliers
from vigilframe.suite.base import query

COLS = "tenant_id, metric_id, history_id, executed_at, status, result_type, result_raw, result_value"
RANKED = """(SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_id
             ORDER BY executed_at DESC, history_id DESC) AS rn FROM {fx_history})"""


@query("e1_latest_history", f"SELECT {COLS} FROM {RANKED} WHERE rn = 1")
def _(t):
    return H.latest(t.fx_history)


PAIR = f"""
    SELECT a.tenant_id, a.metric_id, a.executed_at AS latest_executed_at,
           a.result_value AS latest_value, b.result_value AS previous_value,
           (a.result_value - b.result_value) / nullif(b.result_value, 0) * 100 AS change_rate
    FROM (SELECT * FROM {RANKED} WHERE rn = 1) a
    LEFT JOIN (SELECT * FROM {RANKED} WHERE rn = 2) b
      ON a.tenant_id = b.tenant_id AND a.metric_id = b.metric_id"""


@query(
    "e2_latest_and_previous",
    f"SELECT * REPLACE (round(change_rate, 6) AS change_rate) FROM ({PAIR})",
)
def _(t):
    return H.latest_and_previous(t.fx_history).withColumn("change_rate", F.round("change_rate", 6)).drop(
        "change_label"
    )


@query(
    "e3_change_label",
    f"""SELECT tenant_id, metric_id, printf('%+.1f%%', change_rate) AS change_label
        FROM ({PAIR}) WHERE change_rate IS NOT NULL""",
)
def _(t):
    pairs = H.latest_and_previous(t.fx_history).where(F.col("change_rate").isNotNull())
    return pairs.select(*H.KEYS, "change_label")


@query(
    "e4_chart_change",
    f"""SELECT tenant_id, metric_id, v1 AS latest_value, v2 AS previous_value,
          CASE WHEN v2 = 0 THEN 0.0E0 ELSE round((v1 - v2) / v2 * 100, 6) END AS change_rate
        FROM (SELECT tenant_id, metric_id, coalesce(latest_value, 0) AS v1,
                     coalesce(previous_value, 0) AS v2 FROM ({PAIR}))""",
)
def _(t):
    return H.chart_change(t.fx_history).withColumn("change_rate", F.round("change_rate", 6))


@query(
    "e5_newest_24_histories",
    f"SELECT tenant_id, metric_id, history_id, executed_at, CAST(rn AS INT) AS run_no FROM {RANKED} WHERE rn <= 24",
)
def _(t):
    return H.newest(t.fx_history, 24).select(*H.KEYS, "history_id", "executed_at", "run_no")


@query(
    "e7_run_gaps",
    """SELECT tenant_id, metric_id, history_id, executed_at, previous_executed_at,
         date_sub('second', previous_executed_at, executed_at) AS gap_seconds
       FROM (SELECT *, lag(executed_at) OVER (PARTITION BY tenant_id, metric_id
               ORDER BY executed_at, history_id) AS previous_executed_at FROM {fx_history})""",
)
def _(t):
    return H.run_gaps(t.fx_history)


@query(
    "e8_share_over_partition",
    """SELECT event_type, user_id, cnt,
         round(cnt * 100.0E0 / sum(cnt) OVER (PARTITION BY event_type), 4) AS share_pct
       FROM (SELECT event_type, user_id, count(*) AS cnt FROM {events} GROUP BY 1, 2)""",
)
def _(t):
    counts = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("cnt"))
    return H.with_share(counts, ["event_type"], "cnt")


@query(
    "d19_mean_interval",
    """SELECT tenant_id, metric_id, count(*) AS runs,
         round(CASE WHEN count(*) < 2 THEN 3600.0E0 ELSE date_diff('microsecond', min(executed_at),
           max(executed_at)) / 1e6 / (count(*) - 1) END, 6) AS mean_seconds
       FROM {fx_history} GROUP BY 1, 2""",
)
def _(t):
    return H.mean_interval(t.fx_history).withColumn("mean_seconds", F.round("mean_seconds", 6))


for _range, _hours in H.RANGES.items():

    def _register(name=_range, n=_hours):
        @query(
            f"b6_time_range_{name}",
            f"""SELECT {COLS} FROM {{fx_history}}
                WHERE executed_at >= TIMESTAMP '{NOW}' - INTERVAL '{n}' HOUR""",
        )
        def _(t):
            return H.in_range(t.fx_history, name, ntz(NOW))

    _register()


@query(
    "b14_chart_points",
    """SELECT tenant_id, metric_id, history_id, coalesce(try_cast(result_raw AS DOUBLE), 0) AS chart_value,
         executed_at + INTERVAL '9' HOUR AS local_time, status FROM {fx_history}""",
)
def _(t):
    return H.chart_points(t.fx_history)


@query(
    "h15_runs_today",
    f"SELECT {COLS} FROM {{fx_history}} WHERE CAST(executed_at AS DATE) = DATE '{TODAY}'",
)
def _(t):
    return t.fx_history.where(on_day(F.col("executed_at"), TODAY))


# --- X3, X4, X5 ----------------------------------------------------------------


@query(
    "x3_trend_change",
    """SELECT tenant_id, metric_id, count(*) AS runs, round(regr_slope(result_value, -rn), 6) AS slope,
         coalesce(abs(regr_slope(result_value, -rn) * count(*)) > stddev_samp(result_value), false) AS is_change
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_id
               ORDER BY executed_at DESC, history_id DESC) AS rn
             FROM {fx_history} WHERE result_value IS NOT NULL) WHERE rn <= 24 GROUP BY 1, 2""",
)
def _(t):
    return outliers.trend_change(t.fx_history, H.KEYS, "executed_at", "result_value", "history_id")


@query(
    "x4_hour_pattern",
    """SELECT event_type, hour_of_day, event_id, value, round(z, 6) AS z_score FROM (
         SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z
         FROM (SELECT *, CAST(hour(ts) AS INT) AS hour_of_day FROM {events})
         WINDOW w AS (PARTITION BY event_type, hour_of_day)) WHERE abs(z) > 3""",
)
def _(t):
    return outliers.hour_pattern_anomalies(t.events, ["event_type"], "event_id", "ts", "value")


@query(
    "x5_adaptive_threshold",
    """SELECT event_type, event_id, value, round(m, 6) AS prev_mean, round(s, 6) AS prev_sd FROM (
         SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n
         FROM {events} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
           ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
       WHERE n = 24 AND abs(value - m) > 3 * s""",
)
def _(t):
    hits = outliers.adaptive_threshold(t.events, ["event_type"], ["ts", "event_id"], "value")
    return hits.select(
        "event_type", "event_id", "value", F.round("prev_mean", 6).alias("prev_mean"),
        F.round("prev_sd", 6).alias("prev_sd"),
    )
