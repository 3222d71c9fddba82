"""Quality scan (D), outliers (X1, X2) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.fixtures import PRIMARY_KEYS, TABLE_COLUMNS, TEXT_COLUMNS
from vigilframe.operators import outliers, quality
from vigilframe.plans.scan import scan_tables
from vigilframe.suite.base import query

N_ALL = ["o_orderkey", "n50", "n8", "n3", "n05"]


def _null_rows(table: str, columns: list[str], not_null: tuple[str, ...] = ()) -> str:
    """SQL: column_name, declared_not_null, total_records, null_count."""
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {str(c in not_null).lower()} AS declared_not_null, "
        f"count(*) AS total_records, count(*) - count({c}) AS null_count FROM {table}"
        for c in columns
    )


PROFILE = """
    SELECT *, round(null_count * 100.0E0 / total_records, 4) AS null_pct,
      CASE WHEN null_count = 0 THEN 'none' WHEN declared_not_null THEN 'not_null_violation'
           WHEN null_count * 100 < total_records THEN 'rare'
           WHEN null_count * 20 < total_records THEN 'minority'
           WHEN null_count * 5 < total_records THEN 'unflagged' ELSE 'majority' END AS band,
      CAST(CASE WHEN null_count = 0 THEN 0 WHEN declared_not_null THEN null_count
           WHEN null_count * 20 < total_records THEN 1
           WHEN null_count * 5 < total_records THEN 0 ELSE 1 END AS BIGINT) AS score"""

DETAILS = """
    SELECT column_name, declared_not_null, null_count AS finding_count,
      round(null_count * 100.0E0 / total_records, 2) AS percentage,
      CASE WHEN declared_not_null OR null_count * 100 < total_records THEN 'high'
           WHEN null_count * 20 < total_records THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN declared_not_null THEN 'NOT NULL 컬럼에 NULL 값 존재'
           WHEN null_count * 100 < total_records THEN '극소 NULL 감지'
           WHEN null_count * 20 < total_records THEN '소수 NULL 감지' ELSE '다수 NULL 감지' END
        || ' (' || CAST(round(null_count * 100.0E0 / total_records, 1) AS STRING) || '%)'
        AS description"""


def _counts(table: str, columns: list[str]) -> str:
    """SQL: column_name, value, cnt."""
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM {table} GROUP BY {c}"
        for c in columns
    )


def _scan_sql(table: str, columns: list[str], texts: list[str], key: list[str], not_null: tuple[str, ...] = ()) -> str:
    """SQL: one roll-up row for ``table``."""
    distinct = f"count(DISTINCT {key[0]})" if len(key) == 1 else f"count(DISTINCT ({', '.join(key)}))"
    rare = (
        f"(SELECT count(*) FROM ({_counts(table, texts)}) c "
        f"WHERE value IS NOT NULL AND cnt * 20 < (SELECT count(*) FROM {table}))"
        if texts
        else "0"
    )
    return f"""
      SELECT *, CASE WHEN total_records = 0 THEN 'normal'
               WHEN anomaly_count * 10 >= total_records THEN 'error'
               WHEN anomaly_count * 20 >= total_records THEN 'warning'
               WHEN anomaly_count * 100 >= total_records THEN 'info' ELSE 'normal' END AS status
      FROM (SELECT *, null_count + duplicate_count + distribution_count AS anomaly_count FROM (
        SELECT '{table.strip('{}')}' AS table_name,
          (SELECT count(*) FROM {table}) AS total_records,
          CAST((SELECT sum(score) FROM ({PROFILE} FROM ({_null_rows(table, columns, not_null)}) n) p) AS BIGINT)
            AS null_count,
          (SELECT count(*) - {distinct} FROM {table}) AS duplicate_count,
          CAST({rare} AS BIGINT) AS distribution_count))"""


@query("d1_row_count_lineitem", "SELECT count(*) AS total_records FROM {lineitem}")
def _(t):
    return quality.row_count(t.lineitem)


@query("d2_null_profile_orders", f"{PROFILE} FROM ({_null_rows('{fx_nulls}', N_ALL)}) n")
def _(t):
    return quality.null_profile(t.fx_nulls)


@query(
    "d2_null_profile_lineitem",
    f"{PROFILE} FROM ({_null_rows('{lineitem}', TABLE_COLUMNS['lineitem'])}) n",
)
def _(t):
    return quality.null_profile(t.lineitem)


@query(
    "d3_null_score",
    "SELECT CAST(sum(score) AS BIGINT) AS null_score FROM ("
    f"{PROFILE} FROM ({_null_rows('{fx_nulls}', N_ALL, ('n05',))}) n) p",
)
def _(t):
    return quality.null_profile(t.fx_nulls, not_null=["n05"]).agg(F.sum("score").alias("null_score"))


@query(
    "d4_key_duplicates_lineitem",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count FROM {lineitem}",
)
def _(t):
    return quality.key_duplicates(t.lineitem, PRIMARY_KEYS["lineitem"])


@query(
    "d4_key_duplicates_null_parts",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM {fx_null_keys}))
       AS duplicate_count FROM {fx_null_keys}""",
)
def _(t):
    return quality.key_duplicates(t.fx_null_keys, ["a", "b"])


@query(
    "d4_key_duplicates_single",
    "SELECT count(*) - count(DISTINCT a) AS duplicate_count FROM {fx_null_keys}",
)
def _(t):
    return quality.key_duplicates(t.fx_null_keys, ["a"])


_DUP_DOCS = """
    SELECT text, lang, count(*) AS finding_count,
           CASE WHEN count(*) <= 3 THEN 'medium' ELSE 'high' END AS severity
    FROM {documents} GROUP BY text, lang HAVING count(*) > 1"""


@query("d5_duplicate_rows_top", f"{_DUP_DOCS} ORDER BY finding_count DESC, text, lang LIMIT 5")
def _(t):
    return quality.duplicate_rows(t.documents.select("text", "lang"))


@query("d5_duplicate_row_groups", _DUP_DOCS)
def _(t):
    return quality.duplicate_row_groups(t.documents.select("text", "lang")).withColumn(
        "severity", F.when(F.col("finding_count") <= 3, "medium").otherwise("high")
    )


@query(
    "d5_duplicate_documents",
    """SELECT text, lang, source, n_chars, count(*) AS finding_count FROM {documents}
       GROUP BY text, lang, source, n_chars HAVING count(*) > 1""",
)
def _(t):
    """Documents equal in every column but their id."""
    return quality.duplicate_row_groups(t.documents.drop("doc_id"))


@query(
    "d5_duplicate_rows_whole",
    "SELECT a, b, count(*) AS finding_count FROM {fx_null_keys} GROUP BY a, b HAVING count(*) > 1",
)
def _(t):
    """All columns of a table, NULLs in any of them."""
    return quality.duplicate_row_groups(t.fx_null_keys)


for _table in ("lineitem", "orders", "part", "events", "documents"):

    def _register(table=_table):
        ref = "{" + table + "}"
        counts = _counts(ref, TEXT_COLUMNS[table])

        @query(
            f"d6_category_distribution_{table}",
            f"""SELECT column_name, value, cnt,
                  round(cnt * 100.0E0 / (SELECT count(*) FROM {ref}), 4) AS share_pct
                FROM ({counts}) c""",
        )
        def _(t):
            return quality.category_distribution(getattr(t, table))

        @query(
            f"d7_rare_categories_{table}",
            f"""SELECT column_name, count(*) FILTER (WHERE value IS NOT NULL
                  AND cnt * 20 < (SELECT count(*) FROM {ref})) AS rare_count
                FROM ({counts}) c GROUP BY column_name""",
        )
        def _(t):
            return quality.rare_category_counts(getattr(t, table))

    _register()


def _dominant(table: str, columns: list[str]) -> str:
    return f"""
      SELECT column_name, CAST(sum(cnt) AS BIGINT) AS total_records, count(*) AS groups,
        CAST(coalesce(sum(cnt) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS null_count,
        max_by(value, (cnt, value)) FILTER (WHERE value IS NOT NULL) AS top_value,
        coalesce(max(cnt) FILTER (WHERE value IS NOT NULL), 0) AS top_count,
        count(*) > 1 AND coalesce(max(cnt) FILTER (WHERE value IS NOT NULL), 0) * 10
          >= sum(cnt) * 9 AS is_dominant
      FROM ({_counts(table, columns)}) c GROUP BY column_name"""


@query("d8_dominant_values_skew", _dominant("{fx_skew}", ["k"]))
def _(t):
    return quality.dominant_values(t.fx_skew)


@query("d8_dominant_values_nulls", _dominant("{fx_nulls}", ["n50", "n8", "n3", "n05"]))
def _(t):
    return quality.dominant_values(t.fx_nulls)


def _shares(table: str, columns: list[str]) -> str:
    return f"""
      SELECT column_name, total_records, null_count,
        CASE WHEN top_count * 10 >= total_records * 9 THEN top_value END AS dominant_value,
        CASE WHEN top_count * 10 >= total_records * 9 THEN top_count END AS dominant_count,
        is_dominant
      FROM ({_dominant(table, columns)}) d"""


for _table, _columns in {
    "fx_skew": ["k"], "fx_nulls": ["n50", "n8", "n3", "n05"],
    "documents": TEXT_COLUMNS["documents"], "orders": TEXT_COLUMNS["orders"],
}.items():

    def _register(table=_table, columns=list(_columns)):
        name = f"{{{table}}}" if table.startswith("fx_") else table

        @query(f"d8_dominant_shares_{table.removeprefix('fx_')}", _shares(name, columns))
        def _(t):
            return quality.dominant_shares(getattr(t, table), columns)

    _register()


for _table in ("lineitem", "orders", "documents", "events"):

    def _register_scan(table=_table):
        @query(
            f"d9_scan_rollup_{table}",
            _scan_sql("{" + table + "}", TABLE_COLUMNS[table], TEXT_COLUMNS[table], PRIMARY_KEYS[table]),
        )
        def _(t):
            return quality.scan_table(getattr(t, table), table, PRIMARY_KEYS[table])

    _register_scan()


@query(
    "d9_scan_all_tables",
    " UNION ALL ".join(
        _scan_sql("{" + n + "}", TABLE_COLUMNS[n], TEXT_COLUMNS[n], PRIMARY_KEYS[n]) for n in TABLE_COLUMNS
    ),
)
def _(t):
    return scan_tables({n: getattr(t, n) for n in TABLE_COLUMNS}, PRIMARY_KEYS)


@query(
    "d10_null_details",
    f"""{DETAILS}, CASE WHEN column_name = 'o_orderkey' THEN 'bigint' ELSE 'string' END AS data_type
        FROM ({_null_rows('{fx_nulls}', N_ALL, ('n05',))}) n WHERE null_count > 0""",
)
def _(t):
    return quality.null_details(t.fx_nulls, not_null=["n05"])


@query(
    "d10_null_details_labels",
    f"""{DETAILS}, CASE WHEN column_name IN ('quality', 'toxic') THEN 'int' ELSE 'string' END AS data_type
        FROM ({_null_rows('{fx_label_nulls}', ['doc_id', 'lang', 'source', 'quality', 'toxic'])}) n
        WHERE null_count > 0""",
)
def _(t):
    return quality.null_details(t.fx_label_nulls)


_SAMPLES = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, sample_no, sample_row FROM (
          SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INT) AS sample_no,
                 '{{{{"o_orderkey":' || CAST(o_orderkey AS STRING)
                 || coalesce(',"n50":"' || n50 || '"', '') || coalesce(',"n8":"' || n8 || '"', '')
                 || coalesce(',"n3":"' || n3 || '"', '') || coalesce(',"n05":"' || n05 || '"', '')
                 || '}}}}' AS sample_row
          FROM {{fx_nulls}} WHERE {c} IS NULL) WHERE sample_no <= 5""".replace("{{", "{").replace("}}", "}")
    for c in ("n50", "n8", "n3", "n05")
)


@query("d11_null_samples", _SAMPLES)
def _(t):
    return quality.null_samples(t.fx_nulls, ["o_orderkey"])


def _rarest(table: str, columns: list[str]) -> str:
    total = f"(SELECT count(*) FROM {table})"
    return f"""
      SELECT column_name, value, cnt AS finding_count,
        round(cnt * 100.0E0 / {total}, 2) AS percentage,
        CASE WHEN cnt * 100 < {total} THEN 'high' ELSE 'medium' END AS severity,
        '''' || value || ''' 값이 ' || CAST(cnt AS STRING) || '개('
          || CAST(round(cnt * 100.0E0 / {total}, 1) AS STRING) || '%)로 소수 카테고리' AS description
      FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt, value) AS rarity
            FROM ({_counts(table, columns)}) c WHERE value IS NOT NULL)
      WHERE rarity <= 10 AND cnt * 20 < {total}"""


@query("d12_distribution_details_skew", _rarest("{fx_skew}", ["k"]))
def _(t):
    return quality.distribution_details(t.fx_skew)


@query("d12_distribution_details_part", _rarest("{part}", TEXT_COLUMNS["part"]))
def _(t):
    return quality.distribution_details(t.part)


_DOC = "(SELECT lang, source, quality, toxic FROM {fx_label_nulls})"


@query(
    "g4_findings_list",
    f"""SELECT 'null_values' AS finding_type, column_name, CAST(NULL AS STRING) AS value, finding_count,
               percentage, severity, description
        FROM ({DETAILS} FROM ({_null_rows(_DOC, ['lang', 'source', 'quality', 'toxic'])}) n
              WHERE null_count > 0)
        UNION ALL
        SELECT * FROM (SELECT 'duplicates', CAST(NULL AS STRING), CAST(NULL AS STRING), count(*) AS c,
               CAST(NULL AS DOUBLE), CASE WHEN count(*) <= 3 THEN 'medium' ELSE 'high' END,
               '동일한 레코드가 ' || CAST(count(*) AS STRING) || '번 중복됨'
        FROM {_DOC} GROUP BY ALL HAVING count(*) > 1 ORDER BY c DESC LIMIT 5)
        UNION ALL
        SELECT 'distribution_anomaly', column_name, value, finding_count, percentage, severity, description
        FROM ({_rarest(_DOC, ['lang', 'source'])})""".replace(
        "GROUP BY ALL", "GROUP BY lang, source, quality, toxic"
    ),
)
def _(t):
    return quality.findings(t.fx_label_nulls.select("lang", "source", "quality", "toxic"))


# --- X1, X2 -------------------------------------------------------------------


@query(
    "x1_zscore_outliers",
    """SELECT 'all' AS scope, event_id, value, round((value - m) / s, 6) AS z_score
       FROM {events}, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {events})
       WHERE abs((value - m) / s) > 3""",
)
def _(t):
    return outliers.zscore_outliers(t.events.withColumn("scope", F.lit("all")), ["scope"], "event_id", "value")


@query(
    "x1_zscore_outliers_per_key",
    """SELECT event_type, event_id, value, round(z, 6) AS z_score FROM (
         SELECT event_type, event_id, value, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z
         FROM {events} WINDOW w AS (PARTITION BY event_type)) WHERE abs(z) > 3""",
)
def _(t):
    return outliers.zscore_outliers(t.events, ["event_type"], "event_id", "value")


_QUARTILES = """
    SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM {events} GROUP BY event_type"""


@query(
    "x2_iqr_bounds",
    f"""SELECT event_type, round(q1, 6) AS q1, round(q3, 6) AS q3,
          round(q1 - 1.5E0 * (q3 - q1), 6) AS low_fence, round(q3 + 1.5E0 * (q3 - q1), 6) AS high_fence
        FROM ({_QUARTILES})""",
)
def _(t):
    bounds = outliers.iqr_bounds(t.events, ["event_type"], "value")
    return bounds.select("event_type", *[F.round(c, 6).alias(c) for c in bounds.columns[1:]])


@query(
    "x2_iqr_outliers",
    """SELECT 'all' AS scope, event_id, value FROM {events}, (SELECT quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.75) AS q3 FROM {events})
       WHERE value < q1 - 1.5E0 * (q3 - q1) OR value > q3 + 1.5E0 * (q3 - q1)""",
)
def _(t):
    return outliers.iqr_outliers(t.events.withColumn("scope", F.lit("all")), ["scope"], "event_id", "value")


@query(
    "x2_iqr_outliers_per_key",
    f"""SELECT e.event_type, event_id, value FROM {{events}} e JOIN ({_QUARTILES}) q
          ON e.event_type = q.event_type
        WHERE value < q1 - 1.5E0 * (q3 - q1) OR value > q3 + 1.5E0 * (q3 - q1)""",
)
def _(t):
    return outliers.iqr_outliers(t.events, ["event_type"], "event_id", "value")
