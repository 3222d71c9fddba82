"""Metric history: latest and previous values, change rates, gaps, time ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.scalars import number, percent_change, signed_percent, to_korea_time
from vigilframe.plans.skew import bucketed, lag_in_buckets, lookup_join, newest_per_key

KEYS = ["tenant_id", "metric_id"]

# Chart ranges in hours.
RANGES = {"1h": 1, "6h": 6, "24h": 24, "7d": 24 * 7, "30d": 24 * 30}


def in_range(history: DataFrame, time_range: str | None, now: Column) -> DataFrame:
    """Runs not older than the range; an unknown range keeps all."""
    if time_range not in RANGES:
        return history
    return history.where(F.col("executed_at") >= now - F.make_dt_interval(hours=F.lit(RANGES[time_range])))


def latest(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Newest run per metric, as a combining aggregate rather than a sort."""
    rest = [c for c in history.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("executed_at", "history_id")).alias("_h")
    return history.groupBy(*keys).agg(newest).select(*keys, "_h.*")


def newest(history: DataFrame, n: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``n`` newest runs per metric."""
    return newest_per_key(history, keys, [F.desc("executed_at"), F.desc("history_id")], n, "run_no")


def latest_and_previous(
    history: DataFrame, keys: Sequence[str] = KEYS, raw_text: str | None = None
) -> DataFrame:
    """Latest and previous value per metric with the change between them.

    ``raw_text`` names the column of unread results; the latest is kept as ``latest_raw``. A missing latest or previous value is not skipped: the change is NULL then.
    """
    two = newest(history, 2, keys)

    def pick(n: int, col: str) -> Column:
        return F.max(F.when(F.col("run_no") == n, F.col(col)))

    raw = [pick(1, text).alias("latest_raw") for text in ([raw_text] if raw_text else [])]
    paired = two.groupBy(*keys).agg(
        pick(1, "executed_at").alias("latest_executed_at"),
        pick(1, "result_value").alias("latest_value"),
        pick(2, "result_value").alias("previous_value"),
        *raw,
    )
    return paired.withColumn(
        "change_rate", percent_change(F.col("latest_value"), F.col("previous_value"))
    ).withColumn("change_label", signed_percent(F.col("change_rate")))


def chart_change(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Change shown on a chart: missing values read as 0, no change from 0."""
    filled = history.withColumn("result_value", F.coalesce("result_value", F.lit(0.0)))
    pair = latest_and_previous(filled, keys)
    return pair.select(
        *keys,
        "latest_value",
        F.coalesce("previous_value", F.lit(0.0)).alias("previous_value"),
        F.coalesce("change_rate", F.lit(0.0)).alias("change_rate"),
    )


def run_gaps(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds since the run before, per metric."""
    rows, bucket, order = bucketed(
        history.select(*keys, "history_id", "executed_at"), keys, ["executed_at", "history_id"]
    )
    lagged = lag_in_buckets(rows, keys, order, bucket, {"executed_at": "previous_executed_at"})
    gap = F.timestamp_diff("SECOND", F.col("previous_executed_at"), F.col("executed_at"))
    return lagged.withColumn("gap_seconds", gap)


def mean_interval(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean gap between runs in seconds, one hour below two runs.

    The gaps of a sorted series add up to last minus first, so no sort is needed.
    """
    spread = F.timestamp_diff("MICROSECOND", F.min("executed_at"), F.max("executed_at")) / 1e6
    runs = F.count(F.lit(1))
    return history.groupBy(*keys).agg(
        runs.alias("runs"),
        F.when(runs < 2, F.lit(3600.0)).otherwise(F.try_divide(spread, runs - 1)).alias("mean_seconds"),
    )


def chart_points(history: DataFrame, value: str = "result_raw") -> DataFrame:
    """Chart rows: numeric value else 0, and local time."""
    return history.select(
        *KEYS,
        "history_id",
        F.coalesce(number(F.col(value)), F.lit(0.0)).alias("chart_value"),
        to_korea_time(F.col("executed_at")).alias("local_time"),
        "status",
    )


def with_share(df: DataFrame, keys: Sequence[str], count: str, target: str = "share_pct", digits: int = 4):
    """Share of each row's count in the total of its key.

    Totals are one combined row per key; the join splits a hot key.
    """
    totals = df.groupBy(*keys).agg(F.sum(count).alias("_total"), F.count(F.lit(1)).alias("_n"))
    spread = [c for c in df.columns if c not in keys] or list(keys)
    share = F.round(F.try_divide(F.col(count) * F.lit(100.0), F.col("_total").cast("double")), digits)
    joined = lookup_join(df, totals, keys, spread, rows="_n")
    return joined.withColumn(target, share).drop("_total", "_n")
