"""Metric evaluation and alerting (T)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilframe.fixtures import NOW
from vigilframe.functions.scalars import ntz
from vigilframe.operators import evaluation as E
from vigilframe.operators.history import KEYS, latest_and_previous
from vigilframe.plans import evaluate
from vigilframe.suite.base import query
from vigilframe.suite.history import PAIR

NOW_TS = f"TIMESTAMP '{NOW}'"

CLASSIFIED = """
    SELECT r.tenant_id, r.metric_id, r.run_id, r.executed_at, r.error_message,
      CASE WHEN coalesce(s.n, 0) = 0 THEN 'no_data' WHEN s.n = 1 AND s.c = 1 THEN 'single_value'
           ELSE 'multiple_rows' END AS result_type,
      coalesce(s.n, 0) AS row_count,
      CASE WHEN s.n = 1 AND s.c = 1 THEN s.v END AS result_raw
    FROM {fx_runs} r LEFT JOIN (SELECT run_id, count(DISTINCT row_no) AS n,
      count(DISTINCT col_no) AS c, max(value) AS v FROM {fx_cells} GROUP BY run_id) s
      ON r.run_id = s.run_id"""


@query("t1_classify_runs", CLASSIFIED)
def _(t):
    return E.classify_runs(t.fx_runs, t.fx_cells)


@query(
    "t2_numeric_reading",
    """SELECT history_id, result_raw || suffix AS result_raw, try_cast(result_raw || suffix AS DOUBLE) AS actual_value
       FROM {fx_history} CROSS JOIN (VALUES (''), ('d'), ('f'), (' '), ('e1')) AS s(suffix)""",
)
def _(t):
    suffixes = F.explode(F.array(*[F.lit(x) for x in ("", "d", "f", " ", "e1")]))
    rows = t.fx_history.withColumn("_s", suffixes).withColumn("result_raw", F.concat("result_raw", "_s"))
    return rows.select("history_id", "result_raw", E.number(F.col("result_raw")).alias("actual_value"))


BREACH = """coalesce(CASE threshold_operator WHEN '>' THEN v > threshold_value
      WHEN '>=' THEN v >= threshold_value WHEN '<' THEN v < threshold_value
      WHEN '<=' THEN v <= threshold_value WHEN '==' THEN v = threshold_value
      WHEN '!=' THEN v <> threshold_value END, false)"""
JOINED = """(SELECT h.tenant_id, h.metric_id, h.history_id, h.executed_at, h.result_type, h.result_raw,
      m.threshold_enabled, m.threshold_operator, m.threshold_value,
      try_cast(h.result_raw AS DOUBLE) AS v
    FROM {fx_history} h JOIN {fx_metrics} m ON h.metric_id = m.metric_id AND h.tenant_id = m.tenant_id)"""
ROUTE = """CASE WHEN NOT threshold_enabled THEN CASE WHEN result_type = 'multiple_rows'
      THEN 'categorical' ELSE 'none' END
    WHEN result_type = 'multiple_rows' OR result_raw IS NULL THEN 'none' ELSE 'threshold' END"""


@query(
    "t3_threshold_test",
    f"""SELECT history_id, threshold_operator, threshold_value, v AS actual_value,
          {BREACH} AS is_breach FROM {JOINED}""",
)
def _(t):
    joined = E.with_thresholds(t.fx_history, t.fx_metrics).withColumn(
        "actual_value", E.number(F.col("result_raw"))
    )
    test = E.breaches(F.col("actual_value"), F.col("threshold_operator"), F.col("threshold_value"))
    return joined.select(
        "history_id", "threshold_operator", "threshold_value", "actual_value", test.alias("is_breach")
    )


@query(
    "t4_threshold_anomalies",
    f"""SELECT tenant_id, metric_id, history_id, executed_at AS detected_at,
          CASE WHEN threshold_operator IN ('<', '<=') THEN 'threshold_below'
               ELSE 'threshold_exceeded' END AS anomaly_type, threshold_value, v AS actual_value,
          false AS resolved, false AS notification_sent
        FROM {JOINED} WHERE {ROUTE} = 'threshold' AND {BREACH}""",
)
def _(t):
    return E.threshold_anomalies(t.fx_history, t.fx_metrics)


@query("t5_detector_routing", f"SELECT history_id, {ROUTE} AS detector FROM {JOINED}")
def _(t):
    joined = E.with_thresholds(t.fx_history, t.fx_metrics)
    route = E.detector(F.col("threshold_enabled"), F.col("result_type"), F.col("result_raw"))
    return joined.select("history_id", route.alias("detector"))


RARE = """
    SELECT tenant_id, metric_id, run_id, label, cnt,
      CASE WHEN cnt * 100 < total THEN 'rare_category' ELSE 'minority_category' END AS finding,
      CASE WHEN cnt * 100 < total THEN 'high' ELSE 'medium' END AS severity,
      round(cnt * 100.0E0 / total, 4) AS percentage
    FROM (SELECT *, sum(cnt) OVER (PARTITION BY run_id) AS total FROM {fx_categories})
    WHERE cnt >= 1 AND cnt * 20 < total"""


@query("t6_categorical_rarity", RARE)
def _(t):
    rare = E.categorical_rarity(t.fx_categories, count="cnt")
    return rare.select("tenant_id", "metric_id", "run_id", "label", "cnt", "finding", "severity", "percentage")


@query(
    "t7_categorical_anomalies",
    f"""SELECT tenant_id, metric_id, run_id AS history_id, 'threshold_exceeded' AS anomaly_type, 5.0E0 AS threshold_value,
          CAST(count(*) AS DOUBLE) AS actual_value FROM ({RARE}) GROUP BY tenant_id, metric_id, run_id""",
)
def _(t):
    return E.categorical_anomalies(E.categorical_rarity(t.fx_categories, count="cnt"))


@query(
    "t8_history_rows",
    f"""SELECT tenant_id, metric_id, run_id AS history_id, executed_at,
          CASE WHEN error_message IS NULL THEN 'success' ELSE 'failed' END AS status,
          CASE WHEN error_message IS NULL THEN result_type ELSE 'no_data' END AS result_type,
          CASE WHEN error_message IS NULL THEN result_raw END AS result_raw,
          try_cast(CASE WHEN error_message IS NULL THEN result_raw END AS DOUBLE) AS result_value,
          CASE WHEN error_message IS NULL THEN row_count ELSE 0 END AS row_count, error_message
        FROM ({CLASSIFIED})""",
)
def _(t):
    return E.history_rows(E.classify_runs(t.fx_runs, t.fx_cells))


@query(
    "t8_result_data",
    """SELECT r.tenant_id, r.metric_id, r.run_id AS history_id, r.executed_at, c.row_no, c.col_no, c.col_name, c.value
       FROM {fx_runs} r JOIN {fx_cells} c ON r.run_id = c.run_id WHERE r.error_message IS NULL""",
)
def _(t):
    return E.result_rows(t.fx_runs, t.fx_cells)


@query(
    "t9_notification_feed",
    """SELECT a.anomaly_id, a.tenant_id, a.metric_id, m.name AS metric_name, a.anomaly_type, a.threshold_value,
         a.actual_value FROM {fx_anomalies} a LEFT JOIN {fx_metrics} m ON a.metric_id = m.metric_id AND a.tenant_id = m.tenant_id
       WHERE NOT a.notification_sent AND NOT a.resolved""",
)
def _(t):
    return E.notification_feed(t.fx_anomalies, t.fx_metrics)


# Metrics watched in the fused evaluation and their thresholds.
THRESHOLDS = {
    "event_count": (">", 100.0),
    "event_errors": (">=", 500.0),
    "event_mean_view": ("<", 5.0),
    "order_count": ("!=", 0.0),
    "order_open": ("<=", 10.0),
    "line_returns": ("~", 1.0),
}


def _definitions():
    return {
        "events": {
            "event_count": F.count(F.lit(1)),
            "event_errors": F.count_if(F.col("event_type") == "error"),
            "event_mean_view": F.avg(F.when(F.col("event_type") == "view", F.col("value"))),
        },
        "orders": {
            "order_count": F.count(F.lit(1)),
            "order_open": F.count_if(F.col("o_orderstatus") == "O"),
        },
        "lineitem": {
            "line_returns": F.count_if(F.col("l_returnflag") == "R"),
            "line_quantity": F.sum("l_quantity"),
        },
    }


_T11 = """
    SELECT 'event_count' AS metric_id, CAST(count(*) AS DOUBLE) AS v FROM {events}
    UNION ALL SELECT 'event_errors', count(*) FROM {events} WHERE event_type = 'error'
    UNION ALL SELECT 'event_mean_view', avg(value) FROM {events} WHERE event_type = 'view'
    UNION ALL SELECT 'order_count', count(*) FROM {orders}
    UNION ALL SELECT 'order_open', count(*) FROM {orders} WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'line_returns', count(*) FROM {lineitem} WHERE l_returnflag = 'R'
    UNION ALL SELECT 'line_quantity', sum(l_quantity) FROM {lineitem}"""
_SETTINGS = ", ".join(f"('{m}', '{op}', {v}E0)" for m, (op, v) in THRESHOLDS.items())


@query(
    "t11_evaluate_all_metrics",
    f"""SELECT metric_id, round(v, 6) AS result_value, threshold_operator, threshold_value,
          {BREACH} AS is_anomaly
        FROM ({_T11}) r LEFT JOIN (VALUES {_SETTINGS}) AS s(metric_id, threshold_operator, threshold_value)
        USING (metric_id)""",
)
def _(t):
    results = [evaluate.fused(getattr(t, table), found) for table, found in _definitions().items()]
    together = reduce(lambda a, b: a.unionByName(b), results)
    return evaluate.judged(together.withColumn("result_value", F.round("result_value", 6)), THRESHOLDS)


@query(
    "t11_evaluate_by_user",
    f"""SELECT user_id, metric_id, round(v, 6) AS result_value, threshold_operator, threshold_value,
          {BREACH} AS is_anomaly
        FROM (SELECT user_id, 'event_count' AS metric_id, CAST(count(*) AS DOUBLE) AS v FROM {{events}} GROUP BY 1
              UNION ALL SELECT user_id, 'event_errors', count(*) FILTER (WHERE event_type = 'error')
              FROM {{events}} GROUP BY 1
              UNION ALL SELECT user_id, 'event_mean_view', avg(value) FILTER (WHERE event_type = 'view')
              FROM {{events}} GROUP BY 1) r
        LEFT JOIN (VALUES {_SETTINGS}) AS s(metric_id, threshold_operator, threshold_value)
        USING (metric_id)""",
)
def _(t):
    results = evaluate.fused_by_key(t.events, "user_id", _definitions()["events"])
    return evaluate.judged(results.withColumn("result_value", F.round("result_value", 6)), THRESHOLDS)


def _measures(table, column, value):
    """SQL twin of the measures of one table."""
    ways = {"count": "CAST(count(*) AS DOUBLE)"} | {
        a: f"CAST({a}({value}) AS DOUBLE)" for a in ("sum", "avg", "min", "max")
    }
    parts = []
    for name, text in ways.items():
        fields = f"'{table}' AS table_name, '{name}' AS aggregate"
        parts.append(
            f"SELECT {fields}, {column} AS filter_value, {text} AS v FROM {{{table}}} "
            f"WHERE {column} IS NOT NULL GROUP BY {column}"
        )
        parts.append(f"SELECT {fields}, NULL AS filter_value, {text} AS v FROM {{{table}}}")
    return " UNION ALL ".join(parts)


# Filter and value column of each measured table.
MEASURED = {
    "events": ("event_type", "value"),
    "orders": ("o_orderstatus", "o_totalprice"),
    "lineitem": ("l_returnflag", "l_quantity"),
}
_REGISTRY = f"""(SELECT d.tenant_id, d.metric_id, d.metric_id || '@20240131000000' AS history_id,
      d.threshold_operator, d.threshold_value,
      CASE WHEN d.aggregate = 'count' AND d.table_name <> 'absent' THEN coalesce(r.v, 0) ELSE r.v END AS v
    FROM {{fx_definitions}} d LEFT JOIN ({" UNION ALL ".join(_measures(t, *c) for t, c in MEASURED.items())}) r
      ON r.table_name = d.table_name AND r.aggregate = d.aggregate
      AND r.filter_value IS NOT DISTINCT FROM d.filter_value
    WHERE d.status = 'active')"""


def _registry_history(t):
    frames = [evaluate.measures(getattr(t, name), name, *columns) for name, columns in MEASURED.items()]
    measured = reduce(lambda a, b: a.unionByName(b), frames)
    return evaluate.registry_history(t.fx_definitions, measured, ntz(NOW))


@query(
    "t11_registry_history",
    f"""SELECT tenant_id, metric_id, history_id, {NOW_TS} AS executed_at, 'success' AS status,
          CASE WHEN v IS NULL THEN 'no_data' ELSE 'single_value' END AS result_type,
          round(v, 2) AS result_value, threshold_operator, threshold_value FROM {_REGISTRY}""",
)
def _(t):
    return _registry_history(t).withColumn("result_value", F.round("result_value", 2))


@query(
    "t11_registry_anomalies",
    f"""SELECT tenant_id, metric_id, history_id, {NOW_TS} AS detected_at,
          CASE WHEN threshold_operator IN ('<', '<=') THEN 'threshold_below'
               ELSE 'threshold_exceeded' END AS anomaly_type, threshold_value, round(v, 2) AS actual_value
        FROM {_REGISTRY} WHERE {BREACH}""",
)
def _(t):
    found = evaluate.registry_anomalies(_registry_history(t))
    return found.withColumn("actual_value", F.round("actual_value", 2))


@query(
    "t12_change_alert",
    f"""SELECT tenant_id, metric_id, CASE WHEN round(change_rate, 1) < -20 OR round(change_rate, 1) > 50
          THEN 'warning' ELSE 'normal' END AS alert FROM ({PAIR})""",
)
def _(t):
    pairs = latest_and_previous(t.fx_history)
    return pairs.select(
        "tenant_id", "metric_id", E.change_alert(F.col("change_rate"), F.col("latest_value")).alias("alert")
    )


@query(
    "t12_change_alert_raw",
    """SELECT tenant_id, metric_id, CASE WHEN raw1 = '이상' THEN 'error' WHEN round((v1 - v2) / nullif(v2, 0) * 100, 1) < -20
          OR round((v1 - v2) / nullif(v2, 0) * 100, 1) > 50 THEN 'warning' ELSE 'normal' END AS alert
       FROM (SELECT tenant_id, metric_id, max(result_raw) FILTER (WHERE rn = 1) AS raw1,
               max(result_value) FILTER (WHERE rn = 1) AS v1, max(result_value) FILTER (WHERE rn = 2) AS v2
             FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, metric_id
                     ORDER BY executed_at DESC, history_id DESC) AS rn FROM {fx_alarm_history})
             GROUP BY tenant_id, metric_id)""",
)
def _(t):
    """Alerts from the results as they were read: the alarm text is an error whatever the change."""
    pairs = latest_and_previous(t.fx_alarm_history, raw_text="result_raw")
    return pairs.select(
        "tenant_id", "metric_id", E.change_alert(F.col("change_rate"), F.col("latest_raw")).alias("alert")
    )


@query(
    "t14_latest_category_share",
    """WITH cats AS (SELECT tenant_id, metric_id, history_id, executed_at,
           coalesce(nullif(max(CASE WHEN col_name = 'category' THEN value END), ''),
             nullif(max(CASE WHEN col_name = 'status' THEN value END), ''),
             '항목 ' || CAST(row_number() OVER (PARTITION BY history_id ORDER BY row_no) AS STRING)) AS label,
           coalesce(try_cast(coalesce(max(CASE WHEN col_name = 'count' THEN value END),
             max(CASE WHEN col_name = 'total' THEN value END)) AS DOUBLE), 0) AS v
         FROM (SELECT r.tenant_id, r.metric_id, r.run_id AS history_id, r.executed_at, c.row_no, c.col_name,
                 CASE WHEN c.value = 'N' THEN '' ELSE c.value END AS value
               FROM {fx_runs} r JOIN {fx_cells} c ON r.run_id = c.run_id WHERE r.error_message IS NULL)
         GROUP BY tenant_id, metric_id, history_id, executed_at, row_no),
       last_run AS (SELECT tenant_id, metric_id, max_by(history_id, (executed_at, history_id)) AS history_id
         FROM cats GROUP BY 1, 2)
       SELECT c.tenant_id, c.metric_id, c.history_id, c.label, c.v AS category_value,
         CAST(CASE WHEN sum(c.v) OVER w > 0 THEN floor(c.v * 100 / sum(c.v) OVER w + 0.5) ELSE 0 END AS BIGINT) AS percentage
       FROM cats c JOIN last_run l USING (tenant_id, metric_id, history_id)
       WINDOW w AS (PARTITION BY c.tenant_id, c.metric_id)""",
)
def _(t):
    # Labels and values are picked from the stored cells of each run.
    cells = E.result_rows(t.fx_runs, t.fx_cells)
    cells = cells.withColumn("value", F.when(F.col("value") == "N", "").otherwise(F.col("value")))
    line = Window.partitionBy("history_id").orderBy("row_no")
    names = ["category", "status", "name", "count", "order_count", "total", "value"]
    rows = (
        cells.groupBy(*KEYS, "history_id", "executed_at", "row_no")
        .agg(*[F.max(F.when(F.col("col_name") == c, F.col("value"))).alias(c) for c in names])
        .withColumn("position", F.row_number().over(line))
    )
    return E.latest_category_share(
        rows, "history_id", "executed_at",
        E.picked_label("position", "category", "status", "name"),
        E.picked_value("count", "order_count", "total", "value"),
    )
