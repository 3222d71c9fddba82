"""Monitoring tables derived from the business tables.

Each derived table is one SELECT that Spark and DuckDB both run unchanged, so
the library query and its SQL twin start from the same rows. All of them grow
with the business tables: one metric per customer, one run per event or order,
one catalogued table per order, one catalogued column per line item.

``{TS}`` is the zone-free timestamp type and ``{x}`` another table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vigilframe.session import shuffle_partitions, written, written_in_buckets

NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-30"

# Columns and declared constraints of the business tables.
TABLE_COLUMNS: dict[str, list[str]] = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    ],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
TEXT_COLUMNS: dict[str, list[str]] = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "embeddings": [],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "labels": [],
    "conversations": ["role", "text"],
}
PRIMARY_KEYS: dict[str, list[str]] = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "nation": [("n_regionkey", "region", "r_regionkey")],
    "customer": [("c_nationkey", "nation", "n_nationkey")],
    "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")],
    "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey")],
    "labels": [("doc_id", "documents", "doc_id")],
}

_TENANT = (
    "CASE WHEN {k} % 97 = 96 THEN 'solo' || CAST({k} AS STRING) "
    "ELSE 't' || CAST({k} % 50 AS STRING) END"
)


def _tenant(key: str) -> str:
    return _TENANT.replace("{k}", key)


def _metric(key: str) -> str:
    """Metric ids are unique within a tenant only: neighbours share one."""
    return f"'m' || CAST({key} - {key} % 2 AS STRING)"


DERIVED: dict[str, str] = {
    # --- quality views with NULLs in every band, and a skewed category ---------
    "fx_nulls": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS n50,
               CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS n8,
               CASE WHEN o_orderkey % 33 <> 0 THEN o_orderstatus END AS n3,
               CASE WHEN o_orderkey % 211 <> 0 THEN o_orderstatus END AS n05
        FROM {orders}""",
    "fx_skew": """
        SELECT event_id,
               CASE WHEN event_id % 250 = 0 THEN 'rare' WHEN event_id % 40 = 1 THEN 'minor'
                    ELSE 'main' END AS k
        FROM {events}""",
    "fx_label_nulls": """
        SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # A third of the users and the largest event type are unknown, as the columns allow.
    "fx_null_events": """
        SELECT event_id, ts, CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id,
               CASE WHEN event_type <> 'view' THEN event_type END AS event_type, value
        FROM {events}""",
    "fx_null_keys": """
        SELECT CASE WHEN l_linestatus = 'F' THEN l_orderkey END AS a,
               CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS b
        FROM {lineitem}""",
    # --- metric registry, history, anomalies, detections ----------------------
    "fx_metrics": f"""
        SELECT {_tenant('c_custkey')} AS tenant_id,
               {_metric('c_custkey')} AS metric_id,
               c_name AS name,
               CASE WHEN c_acctbal < 1000 THEN 'paused' WHEN c_acctbal > 9000 THEN 'archived'
                    ELSE 'active' END AS status,
               'c' || CAST(c_nationkey AS STRING) AS db_connection_id,
               c_mktsegment <> 'MACHINERY' AS threshold_enabled,
               CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN '>' WHEN 1 THEN '>=' WHEN 2 THEN '<'
                    WHEN 3 THEN '<=' WHEN 4 THEN '==' WHEN 5 THEN '!=' WHEN 6 THEN '~' END
                    AS threshold_operator,
               CASE WHEN c_custkey % 11 <> 10 THEN CAST(c_nationkey AS DOUBLE) + 0.5E0 END
                    AS threshold_value,
               CASE CAST(c_custkey % 14 AS INT)
                    WHEN 0 THEN 'SELECT count(*) FROM orders'
                    WHEN 1 THEN '  select 1; '
                    WHEN 2 THEN '   '
                    WHEN 3 THEN 'SELECT 1; DROP TABLE x'
                    WHEN 4 THEN '((SELECT 1))'
                    WHEN 5 THEN '-- note' || chr(10) || 'WITH a AS (SELECT 1) SELECT * FROM a'
                    WHEN 6 THEN '/* note */ DELETE FROM orders'
                    WHEN 7 THEN 'COPY orders TO stdout'
                    WHEN 8 THEN 'EXPLAIN ANALYZE SELECT 1'
                    WHEN 9 THEN 'explain explain select 1'
                    WHEN 10 THEN '-- only a comment'
                    WHEN 11 THEN 'SELECT pg_sleep(9)'
                    WHEN 12 THEN 'ANALYZE orders'
                    ELSE 'SELECT '';'' AS c' END || CASE WHEN c_custkey % 14 IN (0, 4, 11)
                         THEN ' -- ' || c_name ELSE '' END AS sql_query,
               CASE WHEN c_custkey % 5 <> 4 THEN CAST('{NOW}' AS {{TS}})
                    - CAST(c_custkey % 49 AS INT) * INTERVAL '1' HOUR END AS sql_generated_at,
               CASE WHEN c_custkey % 6 < 4 THEN true WHEN c_custkey % 6 = 4 THEN false END
                    AS use_cached_sql,
               60 AS schedule_interval_minutes,
               CASE WHEN c_acctbal > 5000 THEN 'sales.' || c_mktsegment || ',Public.Orders'
                    ELSE 'crm.db.Nation_' || CAST(c_nationkey AS STRING) END AS related_tables_csv,
               CAST('{NOW}' AS {{TS}}) - CAST(c_custkey % 1000 AS INT) * INTERVAL '1' HOUR AS created_at,
               c_custkey % 3 AS version
        FROM {{customer}}""",
    # What each metric measures: aggregate over a table, for one filter value or all rows.
    "fx_definitions": """
        SELECT m.tenant_id, m.metric_id, m.status, m.threshold_operator, m.threshold_value,
               CASE c.c_custkey % 4 WHEN 0 THEN 'events' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem'
                    ELSE CASE WHEN c.c_custkey % 8 = 3 THEN 'absent' ELSE 'events' END END AS table_name,
               CASE c.c_custkey % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'sum' WHEN 2 THEN 'avg'
                    WHEN 3 THEN 'min' ELSE 'max' END AS aggregate,
               CASE c.c_custkey % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'view' WHEN 2 THEN 'R' WHEN 3 THEN 'error'
                    WHEN 4 THEN 'O' WHEN 5 THEN 'N' END AS filter_value
        FROM {fx_metrics} m JOIN {customer} c ON m.name = c.c_name""",
    # The same for several filter, group and value columns of four tables; a group column makes a categorical metric.
    "fx_registry": """
        SELECT tenant_id, metric_id, status, threshold_enabled, threshold_operator, threshold_value, table_name,
               CASE WHEN group_column IS NOT NULL AND k % 3 < 2 THEN 'count' WHEN k % 5 = 0 THEN 'count'
                    WHEN k % 5 = 1 THEN 'sum' WHEN k % 5 = 2 THEN 'avg' WHEN k % 5 = 3 THEN 'min' ELSE 'max' END AS aggregate,
               filter_column,
               CASE WHEN filter_column IS NULL THEN NULL WHEN k % 13 = 12 THEN 'never' ELSE
                 CASE filter_column WHEN 'event_type' THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'view' END
                   WHEN 'o_orderstatus' THEN 'O' WHEN 'o_orderpriority' THEN '1-URGENT' WHEN 'l_returnflag' THEN 'R'
                   WHEN 'l_linestatus' THEN 'F' WHEN 'lang' THEN 'fr' ELSE 'web' END END AS filter_value,
               CASE table_name WHEN 'events' THEN 'value' WHEN 'documents' THEN 'n_chars'
                    WHEN 'orders' THEN CASE WHEN k % 2 = 0 THEN 'o_totalprice' ELSE 'o_custkey' END
                    ELSE CASE WHEN k % 2 = 0 THEN 'l_quantity' ELSE 'l_extendedprice' END END AS value_column,
               group_column
        FROM (SELECT *,
                CASE table_name WHEN 'events' THEN CASE WHEN j % 3 = 0 THEN 'event_type' END
                  WHEN 'orders' THEN CASE j % 3 WHEN 0 THEN 'o_orderstatus' WHEN 1 THEN 'o_orderpriority' END
                  WHEN 'lineitem' THEN CASE j % 3 WHEN 0 THEN 'l_returnflag' WHEN 1 THEN 'l_linestatus' END
                  WHEN 'documents' THEN CASE j % 3 WHEN 0 THEN 'lang' WHEN 1 THEN 'source' END END AS filter_column,
                CASE table_name WHEN 'events' THEN CASE WHEN j % 4 = 1 THEN 'event_type' WHEN j % 4 = 2 THEN 'user_id' END
                  WHEN 'orders' THEN CASE WHEN j % 4 = 1 THEN 'o_orderpriority' WHEN j % 4 = 2 THEN 'o_orderdate' END
                  WHEN 'lineitem' THEN CASE WHEN j % 4 = 1 THEN 'l_returnflag' WHEN j % 4 = 2 THEN 'l_quantity' END
                  WHEN 'documents' THEN CASE WHEN j % 4 = 1 THEN 'lang' WHEN j % 4 = 2 THEN 'source' END END AS group_column
              FROM (SELECT m.*, c.c_custkey AS k, CAST((c.c_custkey - c.c_custkey % 4) / 4 AS BIGINT) AS j,
                      CASE c.c_custkey % 4 WHEN 0 THEN 'events' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem'
                        ELSE CASE WHEN c.c_custkey % 16 = 3 THEN 'absent' ELSE 'documents' END END AS table_name
                    FROM {fx_metrics} m JOIN {customer} c ON m.name = c.c_name))""",
    "fx_history": f"""
        SELECT {_tenant('user_id')} AS tenant_id,
               'h' || CAST(event_id AS STRING) AS history_id,
               {_metric('user_id')} AS metric_id,
               ts AS executed_at,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
               CASE WHEN event_type = 'error' THEN 'no_data' WHEN event_type = 'signup'
                    THEN 'multiple_rows' ELSE 'single_value' END AS result_type,
               CASE WHEN event_type IN ('error', 'signup') THEN NULL
                    WHEN event_type = 'click' AND value < 1 THEN 'n/a'
                    ELSE CAST(value AS STRING) END AS result_raw,
               CASE WHEN event_type IN ('error', 'signup') THEN NULL
                    WHEN event_type = 'click' AND value < 1 THEN NULL ELSE value END AS result_value
        FROM {{events}}""",
    # Some runs report a text instead of a number.
    "fx_alarm_history": """
        SELECT tenant_id, metric_id, history_id, executed_at,
               CASE WHEN result_value > 30 THEN '이상' ELSE result_raw END AS result_raw,
               CASE WHEN result_value > 30 THEN NULL ELSE result_value END AS result_value
        FROM {fx_history}""",
    "fx_anomalies": f"""
        SELECT {_tenant('user_id')} AS tenant_id,
               'a' || CAST(event_id AS STRING) AS anomaly_id,
               {_metric('user_id')} AS metric_id,
               'h' || CAST(event_id AS STRING) AS history_id,
               ts + INTERVAL '1' MINUTE AS detected_at,
               CASE WHEN value >= 20 THEN 'threshold_exceeded' ELSE 'threshold_below' END
                    AS anomaly_type,
               CASE WHEN value >= 20 THEN 20.0E0 ELSE 2.0E0 END AS threshold_value,
               value AS actual_value,
               event_type = 'purchase' AS resolved,
               event_type = 'view' AS notification_sent
        FROM {{events}} WHERE value >= 20 OR value < 2""",
    "fx_detections": f"""
        SELECT {_tenant('o_custkey')} AS tenant_id,
               'd' || CAST(o_orderkey AS STRING) AS detection_id,
               'tbl_' || CAST(o_custkey AS STRING) AS table_name,
               o_orderdate AS detected_at,
               CAST(floor(o_totalprice) AS BIGINT) AS total_records,
               o_orderkey % 7 AS null_count,
               o_orderkey % 11 AS duplicate_count,
               o_orderkey % 3 AS distribution_anomaly_count,
               o_orderkey % 7 + o_orderkey % 11 + o_orderkey % 3 AS anomaly_count,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'warning'
                    WHEN '3-MEDIUM' THEN 'info' WHEN '5-LOW' THEN 'normal' END AS status,
               o_orderstatus = 'F' AS is_acknowledged
        FROM {{orders}}""",
    # --- results of metric runs ------------------------------------------------
    "fx_updates": f"""
        SELECT {_tenant('s_suppkey')} AS tenant_id, {_metric('s_suppkey')} AS metric_id,
               s_suppkey % 2 AS version, s_name AS name FROM {{supplier}}
        UNION ALL
        SELECT {_tenant('s_suppkey')}, {_metric('s_suppkey')}, s_suppkey % 3, 'A' || s_name
        FROM {{supplier}} WHERE s_suppkey % 5 < 3
        UNION ALL
        SELECT 'nobody', 'm' || CAST(s_suppkey AS STRING), 0, s_name FROM {{supplier}} WHERE s_suppkey % 7 = 0""",
    "fx_runs": f"""
        SELECT {_tenant('o_custkey')} AS tenant_id, {_metric('o_custkey')} AS metric_id,
               'r' || CAST(o_orderkey AS STRING) AS run_id,
               o_orderdate AS executed_at,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'timeout' END AS error_message
        FROM {{orders}}""",
    "fx_cells": """
        SELECT 'r' || CAST(o_orderkey AS STRING) AS run_id, 1 AS row_no, 1 AS col_no,
               'total' AS col_name,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS STRING) END
               AS value
        FROM {orders} WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT 'r' || CAST(o_orderkey AS STRING), ascii(l_returnflag), c.col_no,
               CASE WHEN c.col_no = 1 THEN 'status' ELSE 'count' END,
               CASE WHEN c.col_no = 1 THEN l_returnflag ELSE CAST(count(*) AS STRING) END
        FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
        CROSS JOIN (SELECT 1 AS col_no UNION ALL SELECT 2 AS col_no) c
        WHERE o_orderstatus = 'O' GROUP BY o_orderkey, l_returnflag, c.col_no""",
    "fx_categories": f"""
        SELECT {_tenant('l_suppkey')} AS tenant_id,
               's' || CAST(l_suppkey - l_suppkey % 2 AS STRING) AS metric_id,
               's' || CAST(l_suppkey AS STRING) || '-' || l_returnflag AS run_id,
               CASE WHEN l_quantity <= 40 THEN 'regular'
                    WHEN l_quantity <= 47 THEN 'q' || CAST(CAST(l_quantity AS INT) AS STRING)
                    ELSE 'q' || CAST(CAST(l_quantity AS INT) AS STRING) || l_linestatus END AS label,
               max(l_shipdate) AS last_seen,
               count(*) AS cnt
        FROM {{lineitem}} GROUP BY 1, 2, 3, 4""",
    # --- system catalog: one table per order, one column per line item ---------
    "pg_namespace": """
        SELECT n_nationkey AS oid,
               CASE n_nationkey WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'information_schema'
                    ELSE lower(n_name) END AS nspname
        FROM {nation}""",
    "pg_class": """
        SELECT o_orderkey AS oid, 'tbl_' || CAST(o_orderkey AS STRING) AS relname,
               CAST(o_custkey % 25 AS INT) AS relnamespace,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'v' ELSE 'r' END AS relkind
        FROM {orders}""",
    "pg_attribute": """
        SELECT l_orderkey AS attrelid, 'col_' || CAST(l_linenumber AS STRING) AS attname,
               l_linenumber AS attnum, min(l_returnflag) AS flag, max(l_partkey) AS ref_key,
               max(l_quantity) AS weight, min(l_linestatus) AS line_status
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "pg_description": """
        SELECT oid AS objoid, 0 AS objsubid, 'Orders table ' || relname AS description
        FROM {pg_class} WHERE relkind = 'r' AND relnamespace < 20
        UNION ALL
        SELECT attrelid, attnum, 'Part ' || CAST(ref_key AS STRING) FROM {pg_attribute}
        WHERE flag = 'R'""",
    "info_columns": """
        SELECT n.nspname AS table_schema, c.relname AS table_name, a.attname AS column_name,
               CASE a.flag WHEN 'A' THEN 'int4' WHEN 'N' THEN 'varchar' ELSE 'timestamptz' END
               AS udt_name,
               CASE WHEN a.line_status = 'F' THEN 'NO' ELSE 'YES' END AS is_nullable,
               CASE WHEN a.weight >= 45 THEN 'now()' END AS column_default,
               a.attnum AS ordinal_position
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid
        JOIN {pg_namespace} n ON c.relnamespace = n.oid""",
    "table_constraints": """
        SELECT 'pk_' || relname AS constraint_name, n.nspname AS table_schema,
               c.relname AS table_name, 'PRIMARY KEY' AS constraint_type
        FROM {pg_class} c JOIN {pg_namespace} n ON c.relnamespace = n.oid
        UNION ALL
        SELECT DISTINCT CASE WHEN c.oid % 5 = 0 THEN 'fkc_' || c.relname
                        ELSE 'fk_' || c.relname || '_' || a.attname END,
               n.nspname, c.relname, 'FOREIGN KEY'
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid
        JOIN {pg_namespace} n ON c.relnamespace = n.oid WHERE a.flag = 'A'""",
    "key_column_usage": """
        SELECT 'pk_' || c.relname AS constraint_name, n.nspname AS table_schema,
               c.relname AS table_name, a.attname AS column_name, a.attnum AS ordinal_position,
               NULL AS position_in_unique_constraint
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid
        JOIN {pg_namespace} n ON c.relnamespace = n.oid WHERE a.weight >= 30
        UNION ALL
        SELECT CASE WHEN c.oid % 5 = 0 THEN 'fkc_' || c.relname ELSE 'fk_' || c.relname || '_' || a.attname END,
               n.nspname, c.relname, a.attname, a.attnum, CASE WHEN c.oid % 5 = 0 THEN a.attnum ELSE 1 END
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid
        JOIN {pg_namespace} n ON c.relnamespace = n.oid WHERE a.flag = 'A'""",
    "constraint_column_usage": """
        SELECT CASE WHEN c.oid % 5 = 0 THEN 'fkc_' || c.relname
                    ELSE 'fk_' || c.relname || '_' || a.attname END AS constraint_name,
               n.nspname AS constraint_schema,
               'tbl_' || CAST(CASE WHEN c.oid % 5 = 0 THEN c.oid + 1 ELSE a.ref_key END AS STRING) AS table_name,
               CASE WHEN c.oid % 5 = 0 THEN 'ref_' || CAST(a.attnum AS STRING) ELSE 'id' END AS column_name,
               CASE WHEN c.oid % 5 = 0 THEN a.attnum ELSE 1 END AS ordinal_position
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid
        JOIN {pg_namespace} n ON c.relnamespace = n.oid WHERE a.flag = 'A'""",
    "index_keys": """
        SELECT 'ix_' || c.relname || '_' || a.line_status AS indexname, c.oid AS indrelid,
               a.line_status = 'F' AS indisunique, a.attnum, a.weight
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid""",
    # --- business context, one row per described table or column ---------------
    "context_tables": """
        SELECT n.nspname || '.' || c.relname AS name,
               'Orders of group ' || CAST(c.relnamespace AS STRING) AS description,
               'Tracks ' || c.relname AS purpose,
               'orders,' || n.nspname AS tags_csv,
               'Orders per day|Revenue of ' || n.nspname AS queries_text,
               'order' AS term, 'Purchase|Sale' AS synonyms_text
        FROM {pg_class} c JOIN {pg_namespace} n ON c.relnamespace = n.oid
        WHERE c.relnamespace < 15""",
    "context_columns": """
        SELECT n.nspname || '.' || c.relname AS name, a.attname AS column_name,
               'Line of part ' || CAST(a.ref_key AS STRING) AS meaning,
               CASE WHEN a.weight >= 40 THEN 'Volume ' || CAST(CAST(a.weight AS INT) AS STRING) END
               AS kpi_description
        FROM {pg_attribute} a JOIN {pg_class} c ON a.attrelid = c.oid
        JOIN {pg_namespace} n ON c.relnamespace = n.oid
        WHERE c.relnamespace < 15 AND a.flag <> 'N'""",
}

# Kept tables that are joined and grouped by one key: that key, and what it is in the table it comes from.
DEALT = {"pg_class": ("oid", "orders", "o_orderkey"), "pg_attribute": ("attrelid", "lineitem", "l_orderkey")}

_REF = re.compile(r"\{(\w+)\}")


def _refs(sql: str) -> list[str]:
    return [name for name in dict.fromkeys(_REF.findall(sql)) if name != "TS"]


def oracle(sql: str) -> str:
    """DuckDB text of ``sql``: every derived table it names becomes a WITH entry."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _refs(text):
            if name in DERIVED and name not in ordered:
                visit(DERIVED[name])
                ordered.append(name)

    visit(sql)

    def plain(text: str) -> str:
        return _REF.sub(lambda m: "TIMESTAMP" if m.group(1) == "TS" else m.group(1), text)

    ctes = ",\n".join(f"{name} AS ({plain(DERIVED[name])})" for name in ordered)
    body = plain(sql)
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


class Lake:
    """Business tables and derived tables of one data folder as DataFrames."""

    # Cards are written before they are enriched.
    writes_cards = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def keep(self, *names: str) -> Lake:
        """Write derived tables to the shared folder once; later uses scan them.

        For tables many parts of one query read, as a catalog is read.
        """
        for name in names:
            if name in DEALT:
                key, source, source_key = DEALT[name]
                dealt = getattr(self, source).repartition(shuffle_partitions(self.spark), source_key)
                self._kept[name] = written_in_buckets(self.sql(DERIVED[name], **{source: dealt}), name, key)
            else:
                self._kept[name] = written(getattr(self, name), name)
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._kept:
            return self._kept[name]
        if name in TABLE_COLUMNS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """Run portable SQL with ``{table}`` references against this folder, or the tables given."""
        frames = {name: given[name] if name in given else getattr(self, name) for name in _refs(text)}
        return self.spark.sql(text.replace("{TS}", "TIMESTAMP_NTZ"), **frames)
