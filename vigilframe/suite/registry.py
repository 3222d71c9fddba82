"""Sources and sinks (A), filters (B), registry joins (C1-C3) and summaries (D13-D23), orders (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.fixtures import NOW
from vigilframe.functions import scalars
from vigilframe.functions.messages import ADVICE
from vigilframe.functions.sql_audit import audit
from vigilframe.operators import registry as R
from vigilframe.operators.history import KEYS
from vigilframe.session import new_table_path
from vigilframe.sources import readers, sinks
from vigilframe.suite.base import query
from vigilframe.suite.history import COLS, PAIR, RANKED

NOW_TS = f"TIMESTAMP '{NOW}'"

# --- A: scans, lookups, sinks ---------------------------------------------------


@query(
    "a1_preview_lineitem",
    """SELECT * FROM {lineitem} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
       LIMIT 10""",
)
def _(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return readers.preview(t.lineitem, order)


@query("a3_point_lookup", "SELECT * FROM {orders} WHERE o_orderkey = 77")
def _(t):
    return readers.lookup(t.orders, o_orderkey=77)


@query("a3_composite_lookup", "SELECT * FROM {conversations} WHERE conv_id = 3 AND turn = 1")
def _(t):
    return readers.lookup(t.conversations, conv_id=3, turn=1)


def _written(t, df, write, name):
    path = new_table_path(t.spark, name)
    write(df, path)
    return t.spark.read.parquet(path)


@query("a9_append_history", f"SELECT {COLS}, CAST(executed_at AS DATE) AS executed_date FROM {{fx_history}}")
def _(t):
    return _written(t, t.fx_history, sinks.append_history, "history")


@query("a10_append_anomalies", "SELECT *, CAST(detected_at AS DATE) AS detected_date FROM {fx_anomalies}")
def _(t):
    return _written(t, t.fx_anomalies, sinks.append_anomalies, "anomalies")


@query("a11_append_detections", "SELECT *, CAST(date_trunc('month', detected_at) AS DATE) AS detected_month FROM {fx_detections}")
def _(t):
    return _written(t, t.fx_detections, sinks.append_detections, "detections")


@query(
    "a12_upsert_documents",
    """SELECT doc_id, lang, n_chars, version FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, src DESC) AS rn FROM (
           SELECT doc_id, lang, n_chars, 1 AS version, 0 AS src FROM {documents}
           UNION ALL
           SELECT doc_id, 'q' || CAST(quality AS STRING), CAST(toxic AS BIGINT),
                  CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END, 1 FROM {labels}))
       WHERE rn = 1""",
)
def _(t):
    base = t.documents.select("doc_id", "lang", "n_chars", F.lit(1).alias("version"))
    updates = t.labels.select(
        "doc_id",
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"),
        F.col("toxic").cast("bigint").alias("n_chars"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2).alias("version"),
    )
    return sinks.upsert(base, updates, ["doc_id"], "version")


_WINNERS = """SELECT u.tenant_id, u.metric_id, min(u.name) AS name FROM {fx_updates} u
         JOIN {fx_metrics} m ON u.tenant_id = m.tenant_id AND u.metric_id = m.metric_id AND u.version = m.version
         GROUP BY 1, 2"""


@query(
    "a13_update_if_unchanged",
    f"""SELECT m.tenant_id, m.metric_id, coalesce(w.name, m.name) AS name,
         m.version + CASE WHEN w.name IS NULL THEN 0 ELSE 1 END AS version,
         CASE WHEN u.n IS NULL THEN 'untouched' WHEN w.name IS NULL THEN 'conflict' ELSE 'updated' END AS outcome
       FROM {{fx_metrics}} m
       LEFT JOIN (SELECT tenant_id, metric_id, count(*) AS n FROM {{fx_updates}} GROUP BY 1, 2) u
         ON u.tenant_id = m.tenant_id AND u.metric_id = m.metric_id
       LEFT JOIN ({_WINNERS}) w ON w.tenant_id = m.tenant_id AND w.metric_id = m.metric_id""",
)
def _(t):
    base = t.fx_metrics.select(*KEYS, "name", "version")
    return sinks.update_if_unchanged(base, t.fx_updates, KEYS, "version", ["name"])


@query(
    "a13_update_outcomes",
    f"""SELECT u.tenant_id, u.metric_id, u.version AS expected_version, u.name,
         CASE WHEN m.version IS NULL THEN 'unknown' WHEN m.version <> u.version THEN 'conflict'
              WHEN w.name = u.name THEN 'updated' ELSE 'superseded' END AS outcome
       FROM {{fx_updates}} u LEFT JOIN {{fx_metrics}} m ON u.tenant_id = m.tenant_id AND u.metric_id = m.metric_id
       LEFT JOIN ({_WINNERS}) w ON w.tenant_id = u.tenant_id AND w.metric_id = u.metric_id""",
)
def _(t):
    return sinks.update_outcomes(t.fx_metrics, t.fx_updates, KEYS, "version", ["name"])


_DOOMED = "SELECT 'd' || CAST(l_orderkey AS STRING) AS detection_id FROM {lineitem} WHERE l_quantity = 50"


def _doomed(t):
    return t.lineitem.where(F.col("l_quantity") == 50).select(
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("detection_id")
    )


@query(
    "a14_acknowledge",
    f"""SELECT *  EXCLUDE (is_acknowledged, detected_at),
          CASE WHEN null_count = 3 THEN false ELSE is_acknowledged END
            OR detection_id IN ({_DOOMED}) AS is_acknowledged,
          CASE WHEN detection_id IN ({_DOOMED}) THEN {NOW_TS} WHEN is_acknowledged THEN detected_at END AS updated_at
        FROM {{fx_detections}}""",
)
def _(t):
    # Some rows were acknowledged earlier, some do not say.
    known = F.when(F.col("null_count") != 3, F.col("is_acknowledged"))
    base = t.fx_detections.withColumn("updated_at", F.when(F.col("is_acknowledged"), F.col("detected_at")))
    marked = sinks.acknowledge(base.withColumn("is_acknowledged", known), _doomed(t), "detection_id", scalars.ntz(NOW))
    return marked.drop("detected_at")


@query("a15_delete_by_id", f"SELECT * FROM {{fx_detections}} WHERE detection_id NOT IN ({_DOOMED})")
def _(t):
    return sinks.delete_rows(t.fx_detections, _doomed(t), ["detection_id"])


@query(
    "a15_deleted_count_by_table",
    """SELECT count(*) AS deleted FROM {fx_detections} d WHERE EXISTS (SELECT 1 FROM {fx_detections} e
         WHERE e.tenant_id = d.tenant_id AND e.table_name = d.table_name AND e.status = 'error')""",
)
def _(t):
    doomed = t.fx_detections.where(F.col("status") == "error")
    return sinks.deleted_count(t.fx_detections, doomed, ["tenant_id", "table_name"])


@query(
    "a16_legacy_defaults",
    """SELECT metric_id, coalesce(use_cached_sql, true) AS use_cached_sql FROM {fx_metrics}""",
)
def _(t):
    return R.with_legacy_defaults(t.fx_metrics).select("metric_id", "use_cached_sql")


@query(
    "a16_legacy_history",
    """SELECT 'h' || CAST(event_id AS STRING) AS history_id,
         CASE WHEN event_type = 'error' THEN 'no_data' ELSE 'single_value' END AS result_type,
         ts AS executed_at FROM {events}""",
)
def _(t):
    old = t.events.select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("history_id"),
        F.when(F.col("event_type") == "error", "no_data").alias("result_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("executed_at"),
    )
    fixed = R.history_with_legacy_defaults(old)
    return fixed.withColumn("executed_at", F.col("executed_at").cast("timestamp_ntz"))


# --- B: filters -------------------------------------------------------------------


@query(
    "b1_list_detections",
    """SELECT * FROM {fx_detections} WHERE tenant_id = 't3' AND status = 'error'
       ORDER BY detected_at DESC, detection_id DESC LIMIT 50""",
)
def _(t):
    return R.list_detections(t.fx_detections, tenant="t3", status="error", n=50)


_METRIC_COLS = "tenant_id, metric_id, name, status, created_at"


@query(
    "b2_list_metrics",
    f"SELECT {_METRIC_COLS} FROM {{fx_metrics}} WHERE status = 'active' AND tenant_id = 't5'",
)
def _(t):
    return R.list_metrics(t.fx_metrics, status="active", tenant="t5").select(*_METRIC_COLS.split(", "))


@query(
    "b3_list_anomalies",
    """SELECT * FROM {fx_anomalies} WHERE resolved = false
       ORDER BY detected_at DESC, anomaly_id DESC LIMIT 100""",
)
def _(t):
    return R.list_anomalies(t.fx_anomalies, resolved=False, n=100)


@query(
    "b4_list_histories",
    f"SELECT {COLS} FROM {{fx_history}} ORDER BY executed_at DESC, history_id DESC LIMIT 100",
)
def _(t):
    return R.list_histories(t.fx_history, n=100)


@query("b5_lookup_anomaly", "SELECT * FROM {fx_anomalies} WHERE history_id = 'h42' OR metric_id = 'm4'")
def _(t):
    return t.fx_anomalies.where((F.col("history_id") == "h42") | (F.col("metric_id") == "m4"))


@query(
    "b7_fetch_limit",
    """SELECT event_type, user_id, count(*) AS cnt FROM {events} GROUP BY 1, 2
       ORDER BY cnt DESC, event_type, user_id LIMIT 100""",
)
def _(t):
    groups = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("cnt"))
    return R.fetch_limited(groups, [F.desc("cnt"), F.col("event_type"), F.col("user_id")], 100)


_REASON = f"""CASE WHEN NOT coalesce(use_cached_sql, true) THEN 'cache_disabled'
    WHEN coalesce(sql_query, '') = '' THEN 'no_sql'
    WHEN {NOW_TS} - sql_generated_at > INTERVAL '24' HOUR THEN 'expired' END"""


@query(
    "b8_sql_refresh",
    f"SELECT metric_id, {_REASON} AS reason, {_REASON} IS NOT NULL AS regenerate FROM {{fx_metrics}}",
)
def _(t):
    return R.sql_refresh(t.fx_metrics, scalars.ntz(NOW)).select("metric_id", "reason", "regenerate")


@query("b9_active_metrics", f"SELECT {_METRIC_COLS} FROM {{fx_metrics}} WHERE status = 'active'")
def _(t):
    return R.active(t.fx_metrics).select(*_METRIC_COLS.split(", "))


_COMMENTS = r"(?s)^(?:--[^\n]*(?:\n|\z)\s*|/\*.*?\*/\s*|/\*.*\z)+"
_AUDIT = rf"""
    SELECT metric_id, sql_query, error_code, error_code IS NULL AS is_valid FROM (
      SELECT *, CASE WHEN s = '' THEN 'empty'
        WHEN n > 1 OR (n = 1 AND NOT ends_with(s, ';')) THEN 'multiple_statements'
        WHEN starts_with(k, '\') OR k IN ('COPY', 'DO', 'CALL', 'LISTEN', 'NOTIFY', 'EXECUTE',
             'PG_SLEEP', 'PG_TERMINATE_BACKEND') THEN 'blocked_keyword'
        WHEN k = 'EXPLAIN' AND w[2] = 'EXPLAIN' THEN 'nested_explain'
        WHEN k = 'EXPLAIN' AND list_contains(w, 'ANALYZE') THEN 'explain_analyze'
        WHEN list_contains(w, 'ANALYZE') THEN 'analyze'
        WHEN k <> '' AND k NOT IN ('SELECT', 'WITH', 'VALUES', 'TABLE', 'EXPLAIN') THEN 'not_read_only'
        END AS error_code
      FROM (SELECT *, upper(split_part(b, ' ', 1)) AS k, regexp_extract_all(upper(b), '[A-Z_]+') AS w,
              length(s) - length(replace(s, ';', '')) AS n
        FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, ';\z', ''),
                '^[\s(]+', ''), '{_COMMENTS}', ''), '\s+', ' ', 'g')) AS b
          FROM (SELECT metric_id, sql_query, regexp_replace(sql_query, '^\s+|\s+\z', '', 'g') AS s
                FROM {{fx_metrics}}))))"""


@query("b11_sql_audit", _AUDIT)
def _(t):
    return audit(t.fx_metrics, "sql_query").select("metric_id", "sql_query", "error_code", "is_valid")


# --- C1-C3: registry joins --------------------------------------------------------


@query(
    "c1_anomaly_feed",
    """SELECT a.tenant_id, a.anomaly_id, a.metric_id, coalesce(m.name, '알 수 없는 지표') AS metric_name,
         a.detected_at, coalesce(m.name, '알 수 없는 지표') || ': ' || CAST(a.actual_value AS STRING)
           || CASE WHEN a.anomaly_type = 'threshold_below' THEN ' is below ' ELSE ' exceeds ' END
           || CAST(a.threshold_value AS STRING) AS message,
         CASE WHEN a.anomaly_type = 'threshold_exceeded' THEN 'error' ELSE 'warning' END AS level, a.resolved
       FROM {fx_anomalies} a LEFT JOIN (SELECT * FROM {fx_metrics} WHERE status <> 'archived') m
         ON a.metric_id = m.metric_id AND a.tenant_id = m.tenant_id""",
)
def _(t):
    return R.anomaly_feed(t.fx_anomalies, t.fx_metrics.where(F.col("status") != "archived"))


@query(
    "c2_metric_list",
    f"""SELECT m.tenant_id, m.metric_id, m.name, m.status, p.latest_executed_at, p.latest_value,
          round(p.change_rate, 6) AS change_rate
        FROM {{fx_metrics}} m LEFT JOIN ({PAIR}) p
          ON m.tenant_id = p.tenant_id AND m.metric_id = p.metric_id""",
)
def _(t):
    return R.metric_list(t.fx_metrics, t.fx_history).select(
        *KEYS, "name", "status", "latest_executed_at", "latest_value",
        F.round("change_rate", 6).alias("change_rate"),
    )


@query(
    "c3_metric_detail",
    f"""SELECT m.tenant_id, m.metric_id, m.name, h.latest_value, h.history_ids,
          coalesce(a.n, 0) AS open_anomalies
        FROM {{fx_metrics}} m
        LEFT JOIN (SELECT tenant_id, metric_id, string_agg(history_id, ',' ORDER BY rn) AS history_ids,
                     max(result_value) FILTER (WHERE rn = 1) AS latest_value
                   FROM {RANKED} WHERE rn <= 24 GROUP BY 1, 2) h USING (tenant_id, metric_id)
        LEFT JOIN (SELECT tenant_id, metric_id, count(*) AS n FROM {{fx_anomalies}} WHERE NOT resolved
                   GROUP BY 1, 2) a USING (tenant_id, metric_id)""",
)
def _(t):
    detail = R.metric_detail(t.fx_metrics, t.fx_history, t.fx_anomalies)
    return detail.select(
        *KEYS,
        "name",
        F.try_element_at("history", F.lit(1))["result_value"].alias("latest_value"),
        F.array_join(F.transform("history", lambda h: h["history_id"]), ",").alias("history_ids"),
        "open_anomalies",
    )


# --- D13-D23, E6, G1: summaries -----------------------------------------------------


@query(
    "d13_detection_summary",
    """SELECT tenant_id, count(*) AS detections, CAST(sum(anomaly_count) AS BIGINT) AS anomalies
       FROM {fx_detections} GROUP BY 1""",
)
def _(t):
    return R.detection_summary(t.fx_detections)


@query(
    "d13_detection_summary_by_status",
    """SELECT tenant_id, coalesce(status, 'normal') AS status, count(*) AS detections,
         CAST(sum(anomaly_count) AS BIGINT) AS anomalies FROM {fx_detections} GROUP BY 1, 2""",
)
def _(t):
    return R.detection_summary(t.fx_detections, by_status=True)


@query(
    "d13_table_breakdown",
    """SELECT tenant_id, detection_id, table_name, 1 AS detection_count, anomaly_count FROM {fx_detections}""",
)
def _(t):
    return R.table_breakdown(t.fx_detections)


@query(
    "d13_breakdown_by_table",
    """SELECT tenant_id, table_name, count(*) AS detection_count,
         CAST(sum(anomaly_count) AS BIGINT) AS anomaly_count FROM {fx_detections} GROUP BY 1, 2""",
)
def _(t):
    return R.breakdown_by_table(t.fx_detections)


@query(
    "d14_filtered_anomaly_count",
    "SELECT count(*) AS anomalies FROM {fx_anomalies} WHERE resolved = false AND tenant_id = 't7'",
)
def _(t):
    return R.matching(t.fx_anomalies, resolved=False, tenant_id="t7").agg(F.count(F.lit(1)).alias("anomalies"))


@query(
    "d15_tenant_summary",
    """SELECT tenant_id, coalesce(n, 0) AS total_metrics, coalesce(act, 0) AS active_metrics,
         coalesce(o, 0) AS open_anomalies
       FROM (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS act
             FROM {fx_metrics} GROUP BY 1)
       FULL JOIN (SELECT tenant_id, count(*) AS o FROM {fx_anomalies} WHERE NOT resolved GROUP BY 1)
         USING (tenant_id)""",
)
def _(t):
    return R.tenant_summary(t.fx_metrics, t.fx_anomalies)


_TABLES = """SELECT DISTINCT tenant_id, lower(regexp_extract(name, '([^.]*)$', 1)) AS table_name
    FROM (SELECT tenant_id, unnest(split(related_tables_csv, ',')) AS name FROM {fx_metrics} WHERE %s)"""


def _with_tables(metrics):
    return metrics.withColumn("related_tables", F.split("related_tables_csv", ","))


@query("d16_monitored_tables", _TABLES % "status = 'active'")
def _(t):
    return R.monitored_tables(_with_tables(R.active(t.fx_metrics)))


@query("g1_all_registered_tables", _TABLES % "true")
def _(t):
    return R.monitored_tables(_with_tables(t.fx_metrics))


@query(
    "f7_sorted_table_list",
    f"SELECT DISTINCT table_name FROM ({_TABLES % 'true'}) ORDER BY table_name",
)
def _(t):
    return R.monitored_tables(_with_tables(t.fx_metrics)).select("table_name").distinct().orderBy("table_name")


_STALE = f"""
    SELECT m.tenant_id, m.metric_id, h.last_run FROM {{fx_metrics}} m
    LEFT JOIN (SELECT tenant_id, metric_id, max(executed_at) AS last_run FROM {{fx_history}} GROUP BY 1, 2) h
      ON m.tenant_id = h.tenant_id AND m.metric_id = h.metric_id
    WHERE h.last_run IS NULL OR h.last_run < {NOW_TS} - INTERVAL '2' HOUR"""


@query("d21_stale_metrics", _STALE)
def _(t):
    return R.stale_metrics(t.fx_metrics, t.fx_history, scalars.ntz(NOW)).select(*KEYS, "last_run")


_RULES = " UNION ALL ".join(
    f"""SELECT tenant_id, {no} AS rule_no, replace('{row_id}', '{{n}}', CAST({n} AS STRING)) AS advice_id,
      '{kind}' AS advice_type, '{priority}' AS priority, '{title}' AS title,
      replace('{text}', '{{n}}', CAST({n} AS STRING)) AS description, '{link}' AS action_url,
      {n} AS advice_count FROM base WHERE {test}"""
    for no, (n, test, (row_id, kind, priority, title, text, link)) in enumerate(
        zip(
            ["recent", "no_alert", "stale", "n"],
            ["recent >= 3", "no_alert > 0", "stale > 0", "n < 3"],
            ADVICE,
        ),
        start=1,
    )
).replace("{n}", "#n#")
_HEALTH = f"""
    WITH base AS (
      SELECT m.tenant_id, m.n, m.no_alert, coalesce(s.n, 0) AS stale, least(coalesce(o.n, 0), 5) AS recent
      FROM (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE NOT threshold_enabled) AS no_alert
            FROM {{fx_metrics}} GROUP BY 1) m
      LEFT JOIN (SELECT tenant_id, count(*) AS n FROM ({_STALE}) GROUP BY 1) s ON m.tenant_id = s.tenant_id
      LEFT JOIN (SELECT tenant_id, count(*) AS n FROM {{fx_anomalies}} WHERE NOT resolved GROUP BY 1) o
        ON m.tenant_id = o.tenant_id)
    SELECT tenant_id, rule_no, advice_id, advice_type, priority, title, description, action_url, advice_count
    FROM ({_RULES})
    QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY rule_no) <= 3"""


@query("d20_registry_health", _HEALTH)
def _(t):
    return R.registry_health(t.fx_metrics, t.fx_history, t.fx_anomalies, scalars.ntz(NOW), limit=3)


@query(
    "d23_open_anomalies_per_metric",
    """SELECT tenant_id, metric_id, count(*) AS open_anomalies FROM {fx_anomalies} WHERE NOT resolved
       GROUP BY 1, 2""",
)
def _(t):
    return R.open_anomaly_counts(t.fx_anomalies)


@query(
    "e6_newest_detection_per_table",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name
         ORDER BY detected_at DESC, detection_id DESC) AS rn FROM {fx_detections}) WHERE rn = 1""",
)
def _(t):
    return R.newest_detection_per_table(t.fx_detections)


# --- E9, F: orders, limits, top-k ---------------------------------------------------


@query(
    "e9_rarest_props_per_type",
    """SELECT event_type, props, cnt, CAST(rn AS INT) AS rn FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cnt, props) AS rn FROM (
           SELECT event_type, props, count(*) AS cnt FROM {events} GROUP BY 1, 2)) WHERE rn <= 10""",
)
def _(t):
    from vigilframe.plans.skew import newest_per_key

    counts = t.events.groupBy("event_type", "props").agg(F.count(F.lit(1)).alias("cnt"))
    return newest_per_key(counts, ["event_type"], [F.col("cnt"), F.col("props")], 10)


@query(
    "f1_newest_per_tenant",
    """SELECT tenant_id, metric_id, created_at, CAST(rn AS INT) AS rn FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, metric_id DESC) AS rn
         FROM {fx_metrics}) WHERE rn <= 10""",
)
def _(t):
    return R.newest_per_tenant(t.fx_metrics, "created_at", "metric_id", 10).select(*KEYS, "created_at", "rn")


@query(
    "f2_top_n_newest",
    f"SELECT {COLS} FROM {{fx_history}} ORDER BY executed_at DESC, history_id DESC LIMIT 25",
)
def _(t):
    return R.newest_first(t.fx_history, "executed_at", "history_id", 25)


@query(
    "f3_limited_detections",
    "SELECT * FROM {fx_detections} ORDER BY detected_at DESC, detection_id DESC LIMIT 20",
)
def _(t):
    return R.list_detections(t.fx_detections, n=20)


@query(
    "f4_top_by_count",
    "SELECT user_id, count(*) AS cnt FROM {events} GROUP BY 1 ORDER BY cnt DESC, user_id LIMIT 5",
)
def _(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "user_id").limit(5)


# --- H: scalar functions over whole tables --------------------------------------------


@query(
    "h2_safe_ids",
    """SELECT metric_id, replace(related_tables_csv, '.', '_') AS safe_id,
         replace(replace(related_tables_csv, '/', '_'), ' ', '_') AS file_name,
         tenant_id || '_' || db_connection_id || '_' || replace(related_tables_csv, '.', '_') AS doc_id
       FROM {fx_metrics}""",
)
def _(t):
    safe = scalars.safe_id(F.col("related_tables_csv"))
    return t.fx_metrics.select(
        "metric_id",
        safe.alias("safe_id"),
        scalars.file_name(F.col("related_tables_csv")).alias("file_name"),
        scalars.composite_id(F.col("tenant_id"), F.col("db_connection_id"), safe).alias("doc_id"),
    )


@query(
    "h10_safe_division",
    """SELECT o_orderkey, round(o_totalprice / nullif(o_orderkey % 4, 0), 6) AS ratio,
         coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, ''), o_orderpriority)
           AS label FROM {orders}""",
)
def _(t):
    blank = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    return t.orders.select(
        "o_orderkey",
        F.round(F.try_divide("o_totalprice", F.col("o_orderkey") % 4), 6).alias("ratio"),
        scalars.first_truthy(blank, F.col("o_orderpriority")).alias("label"),
    )


@query(
    "h13_metric_age",
    f"""SELECT metric_id, date_sub('second', sql_generated_at, {NOW_TS}) AS age_seconds,
          strftime(sql_generated_at, '%Y-%m-%dT%H:%M:%S') AS generated_iso FROM {{fx_metrics}}""",
)
def _(t):
    generated = F.col("sql_generated_at")
    return t.fx_metrics.select(
        "metric_id",
        F.timestamp_diff("SECOND", generated, scalars.ntz(NOW)).alias("age_seconds"),
        F.date_format(generated, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_iso"),
    )


@query(
    "h18_json_round_trip",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         '{"event_id":' || CAST(event_id AS STRING) || ',"event_type":"' || event_type || '"}' AS encoded
       FROM {events}""",
)
def _(t):
    return t.events.select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct("event_id", "event_type")).alias("encoded"),
    )
