"""Evaluation of metric runs: result shape, thresholds, categorical rarity, anomalies.

Run results arrive in long form, one row per cell:
``(run_id, row_no, col_no, col_name, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import messages as msg
from vigilframe.functions.scalars import filled, number
from vigilframe.operators.history import KEYS
from vigilframe.plans.skew import lookup_join

# Comparison operators of a threshold.
OPERATORS = [">", ">=", "<", "<=", "==", "!="]
RARE_PCT = 5.0


def classify_runs(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """Result shape, single value and row count per run.

    Cells are reduced per run map-side before the join, so the join moves one
    row per run. The value is the text of the only cell.
    """
    shape = cells.groupBy("run_id").agg(
        F.count_distinct("row_no").alias("row_count"),
        F.max("col_no").alias("_max_col"),
        F.min("col_no").alias("_min_col"),
        F.max("value").alias("_value"),
    )
    rows = F.coalesce("row_count", F.lit(0).cast("bigint"))
    kind = (
        F.when(rows == 0, "no_data")
        .when((rows == 1) & (F.col("_max_col") == F.col("_min_col")), "single_value")
        .otherwise("multiple_rows")
    )
    return (
        runs.join(shape, "run_id", "left")
        .withColumn("result_type", kind)
        .withColumn("row_count", rows)
        .withColumn("result_raw", F.when(F.col("result_type") == "single_value", F.col("_value")))
        .drop("_value", "_max_col", "_min_col")
    )


def history_rows(classified: DataFrame) -> DataFrame:
    """History rows from classified runs; a failed query still leaves a run without data."""
    failed = F.col("error_message").isNotNull()
    none = F.lit(None)
    return classified.select(
        *KEYS,
        F.col("run_id").alias("history_id"),
        "executed_at",
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, "no_data").otherwise(F.col("result_type")).alias("result_type"),
        F.when(failed, none).otherwise(F.col("result_raw")).alias("result_raw"),
        number(F.when(failed, none).otherwise(F.col("result_raw"))).alias("result_value"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("row_count")).alias("row_count"),
        "error_message",
    )


def result_rows(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """Result data of successful runs beside the history: one row per cell, with tenant and metric."""
    done = runs.where(F.col("error_message").isNull()).select(*KEYS, "run_id", "executed_at")
    return done.join(cells, "run_id").select(
        *KEYS, F.col("run_id").alias("history_id"), "executed_at", "row_no", "col_no", "col_name", "value"
    )


def breaches(value: Column, operator: Column, threshold: Column) -> Column:
    """Threshold test; an unknown operator or a missing side is no breach."""
    test = (
        F.when(operator == ">", value > threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<", value < threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", value == threshold)
        .when(operator == "!=", value != threshold)
    )
    return F.coalesce(test, F.lit(False))


def anomaly_type(operator: Column) -> Column:
    return F.when(operator.isin("<", "<="), "threshold_below").when(
        operator.isin(">", ">=", "==", "!="), "threshold_exceeded"
    )


def detector(enabled: Column, result_type: Column, raw: Column) -> Column:
    """Which detector looks at a run: categorical, threshold or none."""
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), F.when(result_type == "multiple_rows", "categorical").otherwise("none"))
        .when((result_type == "multiple_rows") | raw.isNull(), "none")
        .otherwise("threshold")
    )


def with_thresholds(history: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with the threshold settings of their tenant's metric."""
    settings = metrics.select(*KEYS, "threshold_enabled", "threshold_operator", "threshold_value")
    return lookup_join(history, settings, KEYS, ["history_id"], "inner")


def threshold_anomalies(history: DataFrame, metrics: DataFrame) -> DataFrame:
    """One anomaly per run that breaches the threshold of its metric."""
    joined = with_thresholds(history, metrics).withColumn("actual_value", number(F.col("result_raw")))
    route = detector(F.col("threshold_enabled"), F.col("result_type"), F.col("result_raw"))
    hit = breaches(F.col("actual_value"), F.col("threshold_operator"), F.col("threshold_value"))
    return joined.where((route == "threshold") & hit).select(
        *KEYS,
        "history_id",
        F.col("executed_at").alias("detected_at"),
        anomaly_type(F.col("threshold_operator")).alias("anomaly_type"),
        "threshold_value",
        "actual_value",
        F.lit(False).alias("resolved"),
        F.lit(False).alias("notification_sent"),
    )


def categorical_rarity(
    categories: DataFrame, run: str = "run_id", count: str = "count", totals: DataFrame | None = None
) -> DataFrame:
    """Rare categories of each run: below 1 % high, below 5 % medium, zero counts skipped.

    ``totals`` (run, ``run_total``) are given where a run counts more than the rows here.
    """
    sums = categories.groupBy(run).agg(F.sum(count).alias("run_total"), F.count(F.lit(1)).alias("_n"))
    totals = sums if totals is None else totals.join(sums.drop("run_total"), run)
    spread = [c for c in categories.columns if c != run]
    joined = lookup_join(categories, totals, [run], spread, rows="_n").drop("_n")
    return rare_of_totals(joined, count)


def rare_of_totals(rows: DataFrame, count: str = "cnt") -> DataFrame:
    """Rare categories among rows that carry their run's total: below 1 % high, below 5 % medium."""
    n, total = F.col(count), F.col("run_total")
    return (
        rows.where((n >= 1) & (n * 20 < total))
        .withColumn("finding", F.when(n * 100 < total, "rare_category").otherwise("minority_category"))
        .withColumn("severity", F.when(n * 100 < total, "high").otherwise("medium"))
        .withColumn("percentage", F.round(n * 100.0 / total.cast("double"), 4))
    )


def categorical_anomalies(rare: DataFrame, run: str = "run_id", rows: str | None = None) -> DataFrame:
    """One anomaly per run that holds rare categories, with its tenant and metric.

    A row stands for as many categories as its column ``rows`` says.
    """
    n = F.sum(rows) if rows else F.count(F.lit(1))
    return rare.groupBy(*KEYS, run).agg(n.cast("double").alias("actual_value")).select(
        *KEYS,
        F.col(run).alias("history_id"),
        F.lit("threshold_exceeded").alias("anomaly_type"),
        F.lit(RARE_PCT).alias("threshold_value"),
        "actual_value",
    )


def notification_feed(anomalies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Anomalies nobody has been told about yet, with the metric name."""
    pending = anomalies.where(~F.col("notification_sent") & ~F.col("resolved"))
    names = metrics.select(*KEYS, F.col("name").alias("metric_name"))
    return lookup_join(pending, names, KEYS, ["anomaly_id"]).select(
        "anomaly_id", *KEYS, "metric_name", "anomaly_type", "threshold_value", "actual_value"
    )


def change_alert(change_rate: Column, latest: Column) -> Column:
    """error for the text alarm value, warning below -20 % or above 50 %, else normal.

    The rate is compared after rounding to one decimal, as it is displayed.
    """
    shown = F.round(change_rate, 1)
    return (
        F.when(latest.cast("string") == msg.ALARM, "error")
        .when((shown < -20) | (shown > 50), "warning")
        .otherwise("normal")
    )


def latest_category_share(
    categories: DataFrame, run: str, time: str, label: Column, value: Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Whole-percent share of each category within the newest run of its metric.

    ``time`` is the run's own time on every row. A missing label becomes
    a numbered item by position, a missing value counts as 0.
    """
    rows = categories.withColumn("_label", label).withColumn("_value", F.coalesce(value, F.lit(0.0)))
    last = rows.groupBy(*keys).agg(F.max_by(run, F.struct(time, run)).alias(run))
    current = lookup_join(rows, last, [*keys, run], ["_label", "_value"], "inner")
    totals = current.groupBy(*keys).agg(F.sum("_value").alias("_total"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_total") > 0, F.floor(F.col("_value") * 100 / F.col("_total") + 0.5)).otherwise(0)
    return lookup_join(current, totals, keys, ["_label", "_value"], rows="_n").select(
        *keys,
        run,
        F.col("_label").alias("label"),
        F.col("_value").alias("category_value"),
        share.cast("bigint").alias("percentage"),
    )


def picked_value(*columns: str) -> Column:
    """First present of the value columns, read as a number."""
    return number(F.coalesce(*[F.col(c).cast("string") for c in columns]))


def picked_label(position: str, *columns: str) -> Column:
    """First non-empty label, else the position."""
    return F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in columns],
        filled(msg.ITEM, n=F.col(position)),
    )
