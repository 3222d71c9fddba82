"""Registry, history, anomaly and detection tables: filters, joins, summaries.

Every grouped operator groups by tenant too and serves all tenants in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.messages import ADVICE, UNKNOWN_METRIC
from vigilframe.functions.scalars import filled, hours, last_name_part
from vigilframe.operators.history import KEYS, latest_and_previous, newest
from vigilframe.plans.skew import lookup_join, newest_per_key


def matching(df: DataFrame, **equals) -> DataFrame:
    """AND of equality filters; a filter set to None is left out."""
    tests = [F.col(c) == v for c, v in equals.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def newest_first(df: DataFrame, time: str, row_id: str, n: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.desc(time), F.desc(row_id))
    return ordered if n is None else ordered.limit(n)


def list_detections(df, tenant=None, table=None, status=None, n: int | None = None):
    return newest_first(
        matching(df, tenant_id=tenant, table_name=table, status=status), "detected_at", "detection_id", n
    )


def list_metrics(df, status=None, tenant=None):
    return newest_first(matching(df, status=status, tenant_id=tenant), "created_at", "metric_id")


def list_anomalies(df, metric=None, resolved=None, tenant=None, n: int | None = None):
    return newest_first(
        matching(df, metric_id=metric, resolved=resolved, tenant_id=tenant), "detected_at", "anomaly_id", n
    )


def list_histories(df, metric=None, n: int | None = None):
    return newest_first(matching(df, metric_id=metric), "executed_at", "history_id", n)


def fetch_limited(df: DataFrame, order: Sequence[Column], fetch_limit: int | None = None) -> DataFrame:
    """Result cut to the first rows of a stated order; off by default."""
    return df if fetch_limit is None else df.orderBy(*order).limit(fetch_limit)


def sql_refresh(metrics: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """Whether the cached SQL of a metric must be written anew, and why."""
    reason = (
        F.when(~F.coalesce("use_cached_sql", F.lit(True)), "cache_disabled")
        .when(F.coalesce("sql_query", F.lit("")) == "", "no_sql")
        .when(now - F.col("sql_generated_at") > hours(max_age_hours), "expired")
    )
    return metrics.withColumn("reason", reason).withColumn("regenerate", F.col("reason").isNotNull())


def active(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("status") == "active")


def with_legacy_defaults(metrics: DataFrame) -> DataFrame:
    """Read-back of old documents that lack newer fields."""
    return metrics.withColumn("use_cached_sql", F.coalesce("use_cached_sql", F.lit(True)))


def history_with_legacy_defaults(history: DataFrame) -> DataFrame:
    return history.withColumn("result_type", F.coalesce("result_type", F.lit("single_value"))).withColumn(
        "executed_at", F.to_timestamp("executed_at")
    )


def anomaly_feed(anomalies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Anomalies with the metric name, a message and a level."""
    names = metrics.select(*KEYS, "name")
    joined = lookup_join(anomalies, names, KEYS, ["anomaly_id"])
    metric_name = F.coalesce("name", F.lit(UNKNOWN_METRIC))
    verb = F.when(F.col("anomaly_type") == "threshold_below", " is below ").otherwise(" exceeds ")
    return joined.select(
        "tenant_id",
        "anomaly_id",
        "metric_id",
        metric_name.alias("metric_name"),
        "detected_at",
        F.concat(
            metric_name, F.lit(": "), F.col("actual_value").cast("string"), verb,
            F.col("threshold_value").cast("string"),
        ).alias("message"),
        F.when(F.col("anomaly_type") == "threshold_exceeded", "error").otherwise("warning").alias("level"),
        "resolved",
    )


def metric_list(metrics: DataFrame, history: DataFrame) -> DataFrame:
    """Metrics with latest value, its time and the change from the run before."""
    return metrics.join(latest_and_previous(history), KEYS, "left")


def open_anomaly_counts(anomalies: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return anomalies.where(~F.col("resolved")).groupBy(*keys).agg(F.count(F.lit(1)).alias("open_anomalies"))


def metric_detail(metrics: DataFrame, history: DataFrame, anomalies: DataFrame, n: int = 24) -> DataFrame:
    """Metrics with their ``n`` newest runs (newest first) and open-anomaly count.

    The array holds at most ``n`` items per metric.
    """
    recent = newest(history, n).groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("run_no", "history_id", "executed_at", "result_value"))).alias("history")
    )
    return (
        metrics.join(recent, KEYS, "left")
        .join(open_anomaly_counts(anomalies), KEYS, "left")
        .withColumn("open_anomalies", F.coalesce("open_anomalies", F.lit(0).cast("bigint")))
    )


def detection_summary(detections: DataFrame, by_status: bool = False) -> DataFrame:
    """Detections and anomalies per tenant, optionally per status."""
    keys = ["tenant_id"] + ([F.coalesce("status", F.lit("normal")).alias("status")] if by_status else [])
    return detections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"), F.sum("anomaly_count").alias("anomalies")
    )


def table_breakdown(detections: DataFrame) -> DataFrame:
    """One row per detection, each counted once."""
    return detections.select(
        "tenant_id", "detection_id", F.coalesce("table_name", F.lit("unknown")).alias("table_name"),
        F.lit(1).alias("detection_count"), "anomaly_count",
    )


def breakdown_by_table(detections: DataFrame) -> DataFrame:
    return detections.groupBy("tenant_id", "table_name").agg(
        F.count(F.lit(1)).alias("detection_count"), F.sum("anomaly_count").alias("anomaly_count")
    )


def newest_detection_per_table(detections: DataFrame) -> DataFrame:
    keys = ["tenant_id", "table_name"]
    rest = [c for c in detections.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("detected_at", "detection_id")).alias("_d")
    return detections.groupBy(*keys).agg(best).select(*keys, "_d.*")


def tenant_summary(metrics: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Metrics, active metrics and open anomalies per tenant; one combined shuffle."""
    zero = F.lit(0).cast("bigint")
    m = metrics.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_metrics"),
        F.count_if(F.col("status") == "active").alias("active_metrics"),
    )
    a = open_anomaly_counts(anomalies, ["tenant_id"])
    return m.join(a, "tenant_id", "full").select(
        "tenant_id",
        *[F.coalesce(c, zero).alias(c) for c in ("total_metrics", "active_metrics", "open_anomalies")],
    )


def monitored_tables(metrics: DataFrame, tables: str = "related_tables") -> DataFrame:
    """Distinct lower-cased table names over all given metrics, per tenant."""
    return (
        metrics.select("tenant_id", F.explode(tables).alias("_t"))
        .select("tenant_id", last_name_part(F.col("_t")).alias("table_name"))
        .distinct()
    )


def stale_metrics(metrics: DataFrame, history: DataFrame, now: Column, max_hours: int = 2) -> DataFrame:
    """Metrics without a run or whose newest run is strictly older than ``max_hours``."""
    last = history.groupBy(*KEYS).agg(F.max("executed_at").alias("last_run"))
    old = F.col("last_run").isNull() | (F.col("last_run") < now - hours(max_hours))
    return metrics.join(last, KEYS, "left").where(old)


def registry_health(
    metrics: DataFrame, history: DataFrame, anomalies: DataFrame, now: Column, limit: int = 10
) -> DataFrame:
    """Findings per tenant: many open anomalies, no alerts, stale metrics, few metrics."""
    per_tenant = metrics.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("threshold_enabled")).alias("no_alert")
    )
    stale = stale_metrics(metrics, history, now).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("stale"))
    open_ = open_anomaly_counts(anomalies, ["tenant_id"])
    zero = F.lit(0).cast("bigint")
    base = (
        per_tenant.join(stale, "tenant_id", "left")
        .join(open_, "tenant_id", "left")
        .select(
            "tenant_id",
            "n",
            "no_alert",
            F.coalesce("stale", zero).alias("stale"),
            F.least(F.coalesce("open_anomalies", zero), F.lit(5).cast("bigint")).alias("recent"),
        )
    )

    def rule(no: int, count: str, holds: Column) -> Column:
        row_id, kind, priority, title, text, link = ADVICE[no - 1]
        n = F.col(count)
        return F.when(
            holds,
            F.struct(
                F.lit(no).alias("rule_no"),
                filled(row_id, n=n).alias("advice_id"),
                F.lit(kind).alias("advice_type"),
                F.lit(priority).alias("priority"),
                F.lit(title).alias("title"),
                filled(text, n=n).alias("description"),
                F.lit(link).alias("action_url"),
                n.alias("advice_count"),
            ),
        )

    rules = F.array_compact(
        F.array(
            rule(1, "recent", F.col("recent") >= 3),
            rule(2, "no_alert", F.col("no_alert") > 0),
            rule(3, "stale", F.col("stale") > 0),
            rule(4, "n", F.col("n") < 3),
        )
    )
    return base.select("tenant_id", F.inline(F.slice(rules, 1, limit)))


def newest_per_tenant(df: DataFrame, time: str, row_id: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each tenant."""
    return newest_per_key(df, ["tenant_id"], [F.desc(time), F.desc(row_id)], n)
