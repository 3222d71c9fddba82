"""Hand-computed boundary cases of the quality scan and the detectors."""

import pytest
from pyspark.sql import functions as F

from vigilframe.functions.sql_audit import audit
from vigilframe.operators import evaluation as E
from vigilframe.operators import quality as Q
from vigilframe.operators.registry import stale_metrics
from vigilframe.functions.scalars import ntz


def column_with(spark, total, nulls):
    return spark.range(total).select(F.when(F.col("id") >= nulls, F.lit("x")).alias("c"))


@pytest.mark.parametrize(
    ("nulls", "band", "score"),
    [
        (0, "none", 0), (1, "rare", 1), (9, "rare", 1), (10, "minority", 1), (49, "minority", 1),
        (50, "unflagged", 0), (199, "unflagged", 0), (200, "majority", 1), (1000, "majority", 1),
    ],
)
def test_null_bands_at_their_limits(spark, nulls, band, score):
    row = Q.null_profile(column_with(spark, 1000, nulls)).first()
    assert (row["band"], row["score"], row["null_count"]) == (band, score, nulls)


def test_not_null_column_scores_rows(spark):
    row = Q.null_profile(column_with(spark, 100, 7), not_null=["c"]).first()
    assert (row["band"], row["score"]) == ("not_null_violation", 7)


@pytest.mark.parametrize(("nulls", "severity"), [(9, "high"), (10, "medium"), (49, "medium"), (50, "low")])
def test_null_detail_severity(spark, nulls, severity):
    assert Q.null_details(column_with(spark, 1000, nulls)).first()["severity"] == severity


def test_empty_table(spark):
    empty = column_with(spark, 0, 0)
    row = Q.scan_table(empty, "t", ["c"]).first()
    assert (row["total_records"], row["anomaly_count"], row["status"]) == (0, 0, "normal")
    assert Q.null_details(empty).count() == 0
    assert Q.category_distribution(empty).count() == 0


@pytest.mark.parametrize(
    ("anomalies", "status"),
    [(9, "normal"), (10, "info"), (49, "info"), (50, "warning"), (99, "warning"), (100, "error")],
)
def test_status_limits(spark, anomalies, status):
    df = spark.range(1).select(Q.status_of(F.lit(anomalies), F.lit(1000)).alias("s"))
    assert df.first()["s"] == status


def test_key_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 2), (None, None), (1, 2)], "a int, b int")
    assert Q.key_duplicates(df, ["a", "b"]).first()[0] == 1
    assert Q.key_duplicates(df, ["a"]).first()[0] == 4
    assert Q.key_duplicates(df, []).first()[0] == 0


@pytest.mark.parametrize(("rare", "expected"), [(49, 1), (50, 0)])
def test_exactly_five_percent_is_not_rare(spark, rare, expected):
    df = spark.range(1000).select(F.when(F.col("id") < rare, "a").otherwise("b").alias("k"))
    assert Q.rare_category_counts(df).first()["rare_count"] == expected


@pytest.mark.parametrize(("top", "flag"), [(899, False), (900, True), (1000, False)])
def test_dominant_value_limit(spark, top, flag):
    df = spark.range(1000).select(F.when(F.col("id") < top, "a").otherwise("b").alias("k"))
    assert Q.dominant_values(df).first()["is_dominant"] is flag


def test_long_values_stay_distinct(spark):
    long = "x" * 200
    df = spark.range(1000).select(
        F.when(F.col("id") == 0, long + "a").when(F.col("id") == 1, long + "b").otherwise("c").alias("k")
    )
    assert Q.rare_category_counts(df).first()["rare_count"] == 2


def test_duplicate_rows_order_and_severity(spark):
    df = spark.createDataFrame([(1, None)] * 4 + [(2, "b")] * 3 + [(3, "c")], "a int, b string")
    rows = [(r["a"], r["finding_count"], r["severity"]) for r in Q.duplicate_rows(df).collect()]
    assert rows == [(1, 4, "high"), (2, 3, "medium")]


def test_distribution_sums_to_row_count(spark):
    df = spark.range(777).select((F.col("id") % 13).cast("string").alias("k"))
    assert Q.category_counts(df).agg(F.sum("cnt")).first()[0] == 777


@pytest.mark.parametrize(
    ("sql", "code"),
    [
        ("", "empty"), (" \n ", "empty"), ("SELECT 1;", None), ("SELECT 1;;", "multiple_statements"),
        ("SELECT ';'", "multiple_statements"), ("((select 1))", None), ("-- only", None),
        ("/* open", None), ("/* a */ -- b\nSELECT 1", None), ("WITH x AS (SELECT 1) INSERT INTO t SELECT 1", None),
        ("SELECT pg_sleep(9)", None), ("PG_SLEEP", "blocked_keyword"), ("\\dt", "blocked_keyword"),
        ("copy t to stdout", "blocked_keyword"), ("EXPLAIN EXPLAIN SELECT 1", "nested_explain"),
        ("EXPLAIN (ANALYZE) SELECT 1", "explain_analyze"), ("ANALYZE t", "analyze"),
        ("SELECT analyze FROM t", "analyze"), ("UPDATE t SET a = 1", "not_read_only"), ("TABLE t", None),
    ],
)
def test_sql_audit(spark, sql, code):
    row = audit(spark.createDataFrame([(sql,)], "q string"), "q").first()
    assert row["error_code"] == code and row["is_valid"] == (code is None)


@pytest.mark.parametrize(
    ("op", "value", "hit"),
    [
        (">", 5.0, False), (">", 5.1, True), (">=", 5.0, True), ("<", 4.9, True), ("<", 5.0, False),
        ("<=", 5.0, True), ("==", 5.0, True), ("!=", 5.0, False), ("~", 9.0, False), (None, 9.0, False),
        (">", None, False),
    ],
)
def test_threshold_operators(spark, op, value, hit):
    df = spark.createDataFrame([(value, op)], "v double, op string")
    assert df.select(E.breaches(F.col("v"), F.col("op"), F.lit(5.0)).alias("b")).first()["b"] is hit


def test_result_shapes(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string")
    cells = spark.createDataFrame(
        [("b", 1, 1, "n", None), ("c", 1, 1, "n", "4"), ("d", 1, 1, "n", "4"), ("d", 1, 2, "m", "5")],
        "run_id string, row_no int, col_no int, col_name string, value string",
    )
    got = {r["run_id"]: (r["result_type"], r["result_raw"]) for r in E.classify_runs(runs, cells).collect()}
    assert got == {
        "a": ("no_data", None), "b": ("single_value", None), "c": ("single_value", "4"), "d": ("multiple_rows", None),
    }


def test_zero_counts_are_skipped(spark):
    df = spark.createDataFrame(
        [("r", "a", 0), ("r", "b", 1), ("r", "c", 4), ("r", "d", 5), ("r", "e", 90)], "run_id string, label string, count long"
    )
    got = {r["label"]: r["finding"] for r in E.categorical_rarity(df).collect()}
    assert got == {"b": "minority_category", "c": "minority_category"}


def test_change_alert_uses_the_displayed_rate(spark):
    df = spark.createDataFrame([(-20.04, "1"), (-20.06, "1"), (50.04, "1"), (50.06, "1"), (None, "이상")], "r double, v string")
    got = [r[0] for r in df.select(E.change_alert(F.col("r"), F.col("v"))).collect()]
    assert got == ["normal", "warning", "normal", "warning", "error"]


def test_stale_limit_is_strict(spark):
    metrics = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "tenant_id string, metric_id string")
    history = spark.createDataFrame(
        [("t", "a", "2024-01-01 10:00:00"), ("t", "b", "2024-01-01 09:59:59")], "tenant_id string, metric_id string, at string"
    ).select("tenant_id", "metric_id", F.col("at").cast("timestamp_ntz").alias("executed_at"))
    got = {r["metric_id"] for r in stale_metrics(metrics, history, ntz("2024-01-01 12:00:00")).collect()}
    assert got == {"b", "c"}


@pytest.mark.parametrize(("top", "others", "nulls"), [(89, 11, 0), (90, 10, 0), (90, 0, 10), (89, 0, 11), (100, 0, 0), (0, 100, 0), (0, 0, 5)])
def test_dominant_shares_equal_dominant_values(spark, top, others, nulls):
    rows = [("x" * 200,)] * top + [(f"v{i}",) for i in range(others)] + [(None,)] * nulls
    df = spark.createDataFrame(rows, "c string")
    full, got = Q.dominant_values(df).first(), Q.dominant_shares(df).first()
    assert got["total_records"] == len(rows) and got["null_count"] == nulls
    held = top * 10 >= len(rows) * 9
    assert (got["dominant_value"], got["dominant_count"]) == (("x" * 200, top) if held else (None, None))
    assert got["is_dominant"] == full["is_dominant"]


def test_dominant_shares_shuffle_no_tail(spark):
    """Rows shuffled do not grow with the number of distinct values; empty tables give no row."""
    from vigilframe.session import new_table_path

    path = new_table_path(spark, "shares")
    unique = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("c"))
    unique.withColumn("d", F.when(F.col("c") < "f", "most").otherwise(F.col("c"))).write.parquet(path)
    got = Q.dominant_shares(spark.read.parquet(path))
    assert {r["column_name"]: r["dominant_value"] for r in got.collect()} == {"c": None, "d": "most"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(column_name" in plan
    assert Q.dominant_shares(spark.createDataFrame([], "c string")).count() == 0


def test_a_large_group_of_equal_rows_is_counted_where_it_lies(spark, monkeypatch):
    """A row repeated more often than a task should hold is not dealt by its hash; other groups are as before."""
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 50)
    rows = [(None, None)] * 300 + [(1, None)] * 51 + [(None, 2)] * 50 + [(i, i) for i in range(40)] + [(7, 7), (8, None)]
    found = Q.duplicate_row_groups(spark.createDataFrame(rows, "a long, b int"))
    assert {tuple(r) for r in found.collect()} == {(None, None, 300), (1, None, 51), (None, 2, 50), (7, 7, 2)}
    assert found.count() == 4
