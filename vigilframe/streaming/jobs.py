"""Structured Streaming jobs: windowed metrics, history and anomaly sinks, incremental scans.

The window functions serve batch and stream alike. Every job stops when the
available input is used up (``availableNow``) and continues from its checkpoint
on the next run. Batch sinks write one folder per batch number and overwrite
it, so a batch that is run again after a failure leaves no second copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators.evaluation import RARE_PCT, anomaly_type, breaches, rare_of_totals
from vigilframe.session import new_table_path
from vigilframe.streaming.scan_state import ScanState, write_batch

EPOCH = "1970-01-01 00:00:00"
DELAY = "10 minutes"


def instant(ts: Column) -> Column:
    """Zone-free UTC time as an instant, whatever the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts))


def zone_free(ts: Column) -> Column:
    """Instant as zone-free UTC time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit(EPOCH).cast("timestamp_ntz"))


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_event_time(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events with an instant ``at``; on a stream, rows later than ``delay`` are dropped."""
    timed = events.withColumn("at", instant(F.col("ts")))
    return timed.withWatermark("at", delay) if events.isStreaming else timed


def windowed_metric(
    events: DataFrame, size: str = "1 hour", slide: str | None = None, keys: Sequence[str] = ("event_type",)
) -> DataFrame:
    """Count, sum and mean per key and time window; input needs ``at``."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return (
        events.groupBy(window.alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("value"), 4).alias("total"),
        )
        .select(
            *keys,
            zone_free(F.col("w.start")).alias("window_start"),
            zone_free(F.col("w.end")).alias("window_end"),
            "n",
            "total",
        )
    )


def session_activity(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events per user and session; a session ends after a pause of ``gap``."""
    return (
        events.groupBy(F.session_window("at", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("steps"))
        .select(
            "user_id",
            zone_free(F.col("w.start")).alias("session_start"),
            zone_free(F.col("w.end")).alias("session_end"),
            "steps",
        )
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all available results of a stream to a table, exactly once."""
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all available micro-batches to ``each``."""
    (
        stream.writeStream.outputMode("append")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def history_and_anomalies(
    stream: DataFrame, settings: DataFrame, history: str, anomalies: str, checkpoint: str
) -> None:
    """Hourly metric per event type into a history table, breaches into an anomaly table.

    ``settings`` (metric_id, threshold_operator, threshold_value) are registry rows, joined with each
    batch of runs. Anomalies are judged from the stored runs, so a batch is computed once.
    """

    def each(batch: DataFrame, number: int) -> None:
        runs = batch.select(
            F.col("event_type").alias("metric_id"),
            F.col("window_end").alias("executed_at"),
            F.col("n").cast("double").alias("result_value"),
        )
        write_batch(runs, history, number)
        stored = batch.sparkSession.read.schema(runs.schema).parquet(f"{history}/batch={number}")
        hit = breaches(F.col("result_value"), F.col("threshold_operator"), F.col("threshold_value"))
        found = stored.join(settings, "metric_id").where(hit).select(
            "metric_id",
            F.col("executed_at").alias("detected_at"),
            anomaly_type(F.col("threshold_operator")).alias("anomaly_type"),
            "threshold_value",
            F.col("result_value").alias("actual_value"),
        )
        write_batch(found, anomalies, number)

    run_batches(windowed_metric(with_event_time(stream)), each, checkpoint)


def category_shares(events: DataFrame, label: str, size: str = "1 hour") -> DataFrame:
    """Rows per window and label, with the total of their window; input needs ``at``.

    On a stream two aggregations follow each other, counts per label and totals per window,
    and meet in a join on the window; all state goes once the watermark has passed the window. No
    window is ever held as one list, however many labels it has.
    """
    counts = events.groupBy(F.window("at", size).alias("w"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    totals = (
        counts.select(F.window_time("w").alias("at"), "cnt")
        .groupBy(F.window("at", size).alias("w"))
        .agg(F.sum("cnt").alias("run_total"))
    )
    return counts.alias("c").join(totals.alias("t"), F.col("c.w") == F.col("t.w")).select(
        zone_free(F.col("c.w.start")).alias("window_start"), zone_free(F.col("c.w.end")).alias("window_end"),
        "label", "cnt", "run_total",
    )


def categorical_history(
    stream: DataFrame, label: str, size: str, results: str, anomalies: str, checkpoint: str
) -> None:
    """Category counts of every closed window as result rows, windows with rare categories as anomalies.

    A window's rows all leave the join in the batch that closes it, so each is judged whole.
    """

    def each(batch: DataFrame, number: int) -> None:
        write_batch(batch, results, number)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{results}/batch={number}")
        found = (
            rare_of_totals(stored)
            .groupBy(F.col("window_end").alias("detected_at"))
            .agg(F.count(F.lit(1)).cast("double").alias("actual_value"))
            .select(
                "detected_at",
                F.lit("threshold_exceeded").alias("anomaly_type"),
                F.lit(RARE_PCT).alias("threshold_value"),
                "actual_value",
            )
        )
        write_batch(found, anomalies, number)

    run_batches(category_shares(with_event_time(stream), label, size), each, checkpoint)


def incremental_scan(
    stream: DataFrame, root: str, checkpoint: str, key: Sequence[str] = (), compact_every: int = 8
) -> None:
    """Absorb newly arrived rows, batch by batch, into the :class:`ScanState` below ``root``."""
    state = ScanState(stream.sparkSession, root, stream.schema, key, compact_every)
    run_batches(stream, state.absorb, checkpoint)


def paths(spark: SparkSession, name: str, *parts: str) -> list[str]:
    """Fresh folders for the tables and the checkpoint of one job."""
    root = new_table_path(spark, name)
    return [f"{root}/{part}" for part in parts]
