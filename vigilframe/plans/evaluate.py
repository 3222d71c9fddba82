"""Evaluate many registered metrics together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.evaluation import anomaly_type, breaches
from vigilframe.operators.history import KEYS
from vigilframe.operators.registry import active
from vigilframe.plans.skew import null_safe_join
from vigilframe.session import written


def fused(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """All single-value metrics over one table from one aggregate.

    Each metric is an aggregate expression, restricted rows included in it
    (``count_if``, ``sum(when ...)``), so the table is scanned once however
    many metrics watch it. Output: (metric_id, result_raw, result_value).
    """
    names = list(metrics)
    wide = df.agg(*[metrics[m].cast("double").alias(f"_{i}") for i, m in enumerate(names)])
    cells = [
        F.struct(F.lit(m).alias("metric_id"), F.col(f"_{i}").alias("result_value"))
        for i, m in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*cells)))


def fused_by_key(df: DataFrame, key: str, metrics: Mapping[str, Column]) -> DataFrame:
    """As :func:`fused`, one value per metric and key; partial sums are built map-side."""
    names = list(metrics)
    wide = df.groupBy(key).agg(*[metrics[m].cast("double").alias(f"_{i}") for i, m in enumerate(names)])
    cells = [
        F.struct(F.lit(m).alias("metric_id"), F.col(f"_{i}").alias("result_value"))
        for i, m in enumerate(names)
    ]
    return wide.select(key, F.inline(F.array(*cells)))


def judged(results: DataFrame, thresholds: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Results with threshold settings and verdict; metrics without a threshold are never anomalous."""
    pairs = [x for m, (op, v) in thresholds.items() for x in (F.lit(m), F.struct(F.lit(op), F.lit(float(v))))]
    setting = F.try_element_at(F.create_map(*pairs), F.col("metric_id"))
    return (
        results.withColumn("_s", setting)
        .withColumn("threshold_operator", F.col("_s.col1"))
        .withColumn("threshold_value", F.col("_s.col2"))
        .drop("_s")
        .withColumn(
            "is_anomaly",
            breaches(F.col("result_value"), F.col("threshold_operator"), F.col("threshold_value")),
        )
    )


# Aggregates a registered metric can ask for.
AGGREGATES = ["count", "sum", "avg", "min", "max"]


def measures(df: DataFrame, table: str, filter_column: str, value_column: str) -> DataFrame:
    """All aggregates of one table, for every filter value and for all rows.

    One grouped scan serves every metric over the table, however many there are. Output:
    (table_name, aggregate, filter_value, result_value); a NULL filter value means all
    rows. Rows whose filter column is NULL count for all rows only.
    """
    value = F.col(value_column).cast("double")
    groups = df.groupBy(F.col(filter_column).cast("string").alias("filter_value")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.sum(value).alias("_sum"),
        F.min(value).alias("_min"), F.max(value).alias("_max"),
    )
    groups = written(groups, "measures")
    whole = groups.agg(
        F.lit(None).cast("string").alias("filter_value"), F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"),
        F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"), F.max("_max").alias("_max"),
    )
    results = {
        "count": F.coalesce("_rows", F.lit(0)).cast("double"),
        "sum": F.col("_sum"),
        "avg": F.try_divide("_sum", "_n"),
        "min": F.col("_min"),
        "max": F.col("_max"),
    }
    cells = [F.struct(F.lit(a).alias("aggregate"), results[a].alias("result_value")) for a in AGGREGATES]
    both = groups.where("filter_value is not null").unionByName(whole)
    return both.select(F.lit(table).alias("table_name"), "filter_value", F.inline(F.array(*cells)))


def registry_history(definitions: DataFrame, measured: DataFrame, now: Column) -> DataFrame:
    """History rows of all active metrics of all tenants, in one join of registry and measures.

    ``definitions``: tenant, metric, status, table_name, aggregate, filter_value and the
    threshold settings, which are carried along. A filter value that never occurs counts
    zero rows; other aggregates of it, and metrics over an unknown table, have no data.
    """
    known = measured.select("table_name").distinct().withColumn("_known", F.lit(True))
    on = ["table_name", "aggregate", "filter_value"]
    joined = null_safe_join(active(definitions), measured, on, "left").join(known, "table_name", "left")
    value = F.when(
        (F.col("aggregate") == "count") & F.col("_known"), F.coalesce("result_value", F.lit(0.0))
    ).otherwise(F.col("result_value"))
    return joined.withColumn("result_value", value).select(
        *KEYS,
        F.concat_ws("@", "metric_id", F.date_format(now, "yyyyMMddHHmmss")).alias("history_id"),
        now.alias("executed_at"),
        F.lit("success").alias("status"),
        F.when(F.col("result_value").isNull(), "no_data").otherwise("single_value").alias("result_type"),
        "result_value",
        "threshold_operator",
        "threshold_value",
    )


def registry_anomalies(history: DataFrame) -> DataFrame:
    """One anomaly row per run of ``registry_history`` that breaches its metric's threshold."""
    hit = breaches(F.col("result_value"), F.col("threshold_operator"), F.col("threshold_value"))
    return history.where(hit).select(
        *KEYS,
        "history_id",
        F.col("executed_at").alias("detected_at"),
        anomaly_type(F.col("threshold_operator")).alias("anomaly_type"),
        "threshold_value",
        F.col("result_value").alias("actual_value"),
    )
