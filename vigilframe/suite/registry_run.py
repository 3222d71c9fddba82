"""Runs of the whole registry and scans of the tables it names, read back from the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.fixtures import NOW, PRIMARY_KEYS, TABLE_COLUMNS, TEXT_COLUMNS
from vigilframe.functions.scalars import ntz
from vigilframe.plans import registry_run as R
from vigilframe.suite.base import query
from vigilframe.suite.evaluation import BREACH, NOW_TS, ROUTE
from vigilframe.suite.quality import DETAILS, _null_rows, _rarest, _scan_sql

# Tables the registry may name, with the columns its definitions use.
AXES = {
    "events": (["event_type", "user_id"], ["value"]),
    "orders": (["o_orderstatus", "o_orderpriority", "o_orderdate"], ["o_totalprice", "o_custkey"]),
    "lineitem": (["l_returnflag", "l_linestatus", "l_quantity"], ["l_quantity", "l_extendedprice"]),
    "documents": (["lang", "source"], ["n_chars"]),
}
STAMP = "20240131000000"


def _cells() -> str:
    """SQL: every axis and value of every row of the tables, in long form: one row per table, filter and group column."""
    parts = []
    for table, (axes, values) in AXES.items():
        for f in (None, *axes):
            for g in (None, *axes):
                for v in values:
                    text = lambda c: f"CAST({c} AS STRING)" if c else "CAST(NULL AS STRING)"
                    name = lambda c: f"'{c}'" if c else "CAST(NULL AS STRING)"
                    # Dates as texts are written alike by both engines; whole quantities are not.
                    label = f"CAST({g} AS DOUBLE)" if g == "l_quantity" else g
                    parts.append(
                        f"SELECT '{table}' AS table_name, {name(f)} AS filter_column, {text(f)} AS filter_value, "
                        f"{name(g)} AS group_column, {text(label) if g else text(None)} AS label, '{v}' AS value_column, "
                        f"count(*) AS n, CAST(sum({v}) AS DOUBLE) AS s, CAST(avg({v}) AS DOUBLE) AS a, "
                        f"CAST(min({v}) AS DOUBLE) AS lo, CAST(max({v}) AS DOUBLE) AS hi FROM {{{table}}} GROUP BY ALL"
                    )
    return "\nUNION ALL ".join(parts)


_RUNS = f"""
    cells AS ({_cells()}),
    runs AS (SELECT d.*, d.metric_id || '@{STAMP}' AS history_id, c.label, c.n,
        CASE d.aggregate WHEN 'count' THEN CASE WHEN d.group_column IS NULL AND d.table_name <> 'absent'
               THEN coalesce(c.n, 0) ELSE c.n END
             WHEN 'sum' THEN c.s WHEN 'avg' THEN c.a WHEN 'min' THEN c.lo ELSE c.hi END AS v0
      FROM {{fx_registry}} d LEFT JOIN cells c ON c.table_name = d.table_name AND c.value_column = d.value_column
        AND c.filter_column IS NOT DISTINCT FROM d.filter_column AND c.filter_value IS NOT DISTINCT FROM d.filter_value
        AND c.group_column IS NOT DISTINCT FROM d.group_column
      WHERE d.status = 'active'),
    hist AS (SELECT tenant_id, metric_id, history_id, {NOW_TS} AS executed_at, 'success' AS status, threshold_enabled,
        threshold_operator, threshold_value, CAST(CASE WHEN group_column IS NULL THEN max(v0) END AS DOUBLE) AS v,
        CASE WHEN group_column IS NOT NULL AND count(n) > 0 THEN 'multiple_rows'
             WHEN group_column IS NULL AND max(v0) IS NOT NULL THEN 'single_value' ELSE 'no_data' END AS result_type,
        CASE WHEN group_column IS NOT NULL THEN count(n) WHEN max(v0) IS NOT NULL THEN 1 ELSE 0 END AS row_count
      FROM runs GROUP BY tenant_id, metric_id, history_id, group_column, threshold_enabled, threshold_operator, threshold_value),
    routed AS (SELECT *, {ROUTE} AS route FROM (SELECT *, v AS result_raw FROM hist)),
    rare AS (SELECT tenant_id, metric_id, history_id, label, n AS cnt,
        CASE WHEN n * 100 < total THEN 'rare_category' ELSE 'minority_category' END AS finding,
        CASE WHEN n * 100 < total THEN 'high' ELSE 'medium' END AS severity, round(n * 100.0E0 / total, 4) AS percentage
      FROM (SELECT r.tenant_id, r.metric_id, r.history_id, r.label, r.n,
              sum(r.n) OVER (PARTITION BY r.tenant_id, r.metric_id) AS total
            FROM runs r JOIN routed h ON h.tenant_id = r.tenant_id AND h.metric_id = r.metric_id
            WHERE h.route = 'categorical' AND r.aggregate = 'count' AND r.n IS NOT NULL)
      WHERE n * 20 < total)"""


def _stored(t, digits: int | None = None) -> dict:
    tables = {name: getattr(t, name) for name in AXES}
    return R.run_registry(t.fx_registry, tables, ntz(NOW), digits=digits)


@query(
    "t11_run_history",
    f"""WITH {_RUNS} SELECT tenant_id, metric_id, history_id, executed_at, status, result_type, round(v, 2) AS result_value,
          row_count, threshold_enabled, threshold_operator, threshold_value FROM hist""",
)
def _(t):
    """History of a run of all tenants' metrics, single values and categorical results alike."""
    rows = _stored(t)["history"]
    return rows.withColumn("result_value", F.round("result_value", 2))


@query(
    "t11_run_results",
    f"""WITH {_RUNS} SELECT tenant_id, metric_id, history_id, {NOW_TS} AS executed_at, aggregate, label,
          round(CAST(v0 AS DOUBLE), 2) AS category_value
        FROM runs WHERE group_column IS NOT NULL AND n IS NOT NULL""",
)
def _(t):
    """Stored rows of categorical results."""
    return _stored(t, digits=2)["results"]


@query("t11_run_findings", f"WITH {_RUNS} SELECT *, {NOW_TS} AS executed_at FROM rare")
def _(t):
    """Stored rare categories of all tenants' categorical metrics."""
    return _stored(t)["findings"]


@query(
    "t11_run_anomalies",
    f"""WITH {_RUNS}
        SELECT tenant_id, metric_id, history_id, executed_at AS detected_at, CASE WHEN threshold_operator IN ('<', '<=')
          THEN 'threshold_below' ELSE 'threshold_exceeded' END AS anomaly_type, threshold_value, round(v, 2) AS actual_value
        FROM routed WHERE route = 'threshold' AND {BREACH}
        UNION ALL
        SELECT tenant_id, metric_id, history_id, {NOW_TS}, 'threshold_exceeded', 5.0E0, CAST(count(*) AS DOUBLE)
        FROM rare GROUP BY tenant_id, metric_id, history_id""",
)
def _(t):
    """Stored anomalies: breaches of thresholds, and runs that hold rare categories."""
    return _stored(t)["anomalies"].withColumn("actual_value", F.round("actual_value", 2))


def _scanned(t) -> dict:
    tables = {name: getattr(t, name) for name in TABLE_COLUMNS}
    return R.scan_monitored(t.fx_registry, tables, PRIMARY_KEYS, ntz(NOW))


@query(
    "d9_scan_registered_tables",
    f"SELECT table_name || '@{STAMP}' AS detection_id, *, {NOW_TS} AS detected_at FROM ("
    + " UNION ALL ".join(_scan_sql("{" + n + "}", TABLE_COLUMNS[n], TEXT_COLUMNS[n], PRIMARY_KEYS[n]) for n in AXES)
    + ")",
)
def _(t):
    """Stored detections of the tables that active registry rows name."""
    return _scanned(t)["detections"]


_FINDINGS = "\nUNION ALL ".join(
    f"""SELECT '{n}' AS table_name, 'null_values' AS finding_type, column_name, CAST(NULL AS STRING) AS value, finding_count,
          percentage, severity, description FROM ({DETAILS} FROM ({_null_rows('{' + n + '}', TABLE_COLUMNS[n])}) n WHERE null_count > 0)
        UNION ALL
        SELECT '{n}', 'distribution_anomaly', column_name, value, finding_count, percentage, severity, description
        FROM ({_rarest('{' + n + '}', TEXT_COLUMNS[n])})"""
    for n in AXES
)


@query(
    "a11_saved_findings",
    f"SELECT table_name || '@{STAMP}' AS detection_id, *, {NOW_TS} AS detected_at FROM ({_FINDINGS})",
)
def _(t):
    """Stored findings of those scans, read back; these tables hold no repeated rows."""
    return _scanned(t)["findings"]
