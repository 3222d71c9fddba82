"""Numeric outliers, trend and adaptive thresholds over metric values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.plans.skew import (
    bucketed,
    exact_percentiles,
    index_in_buckets,
    lookup_join,
    newest_per_key,
    previous_rows_stats,
)


def zscore_outliers(
    df: DataFrame, keys: Sequence[str], row_id: str, value: str, limit: float = 3.0
) -> DataFrame:
    """Rows further than ``limit`` sample deviations from the mean of their key."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.count(F.lit(1)).alias("_n")
    )
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return (
        lookup_join(df, stats, keys, [row_id], "inner", rows="_n")
        .withColumn("z_score", z)
        .where(F.abs("z_score") > limit)
        .select(*keys, row_id, value, F.round("z_score", 6).alias("z_score"))
    )


def iqr_bounds(df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5) -> DataFrame:
    """Exact quartiles and fences per key."""
    span = F.col("p1") - F.col("p0")
    return exact_percentiles(df, keys, value, [0.25, 0.75]).select(
        *keys,
        F.col("p0").alias("q1"),
        F.col("p1").alias("q3"),
        (F.col("p0") - factor * span).alias("low_fence"),
        (F.col("p1") + factor * span).alias("high_fence"),
    )


def iqr_outliers(
    df: DataFrame, keys: Sequence[str], row_id: str, value: str, factor: float = 1.5
) -> DataFrame:
    """Rows outside the fences of their key."""
    bounds = iqr_bounds(df, keys, value, factor)
    outside = (F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence"))
    return (
        lookup_join(df.select(*keys, row_id, value), bounds, keys, [row_id], "inner")
        .where(outside)
        .select(*keys, row_id, value)
    )


def trend_change(
    history: DataFrame, keys: Sequence[str], time: str, value: str, tie: str, n: int = 24, k: float = 1.0
) -> DataFrame:
    """Least-squares slope over the last ``n`` runs; flagged when the drift exceeds ``k`` deviations."""
    recent = newest_per_key(
        history.where(F.col(value).isNotNull()), keys, [F.desc(time), F.desc(tie)], n
    )
    fitted = recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.regr_slope(F.col(value), -F.col("rn").cast("double")).alias("_slope"),
        F.stddev_samp(value).alias("_sd"),
    )
    return fitted.select(
        *keys,
        "runs",
        F.round("_slope", 6).alias("slope"),
        F.coalesce(F.abs(F.col("_slope") * F.col("runs")) > k * F.col("_sd"), F.lit(False)).alias("is_change"),
    )


def hour_pattern_anomalies(
    history: DataFrame, keys: Sequence[str], row_id: str, time: str, value: str, limit: float = 3.0
) -> DataFrame:
    """Runs far from the mean of the same key at the same hour of day."""
    by_hour = history.withColumn("hour_of_day", F.hour(time))
    return zscore_outliers(by_hour, [*keys, "hour_of_day"], row_id, value, limit)


def adaptive_threshold(
    history: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    n: int = 24,
    k: float = 3.0,
) -> DataFrame:
    """Runs outside mean +- ``k`` deviations of the ``n`` runs before them."""
    known = history.where(F.col(value).isNotNull())
    rows, bucket, places = bucketed(known, keys, order)
    indexed = index_in_buckets(rows, keys, places, bucket, "run_index")
    scored = previous_rows_stats(indexed, keys, "run_index", value, n)
    far = F.abs(F.col(value) - F.col("prev_mean")) > k * F.col("prev_sd")
    return scored.where((F.col("prev_n") == n) & far)
