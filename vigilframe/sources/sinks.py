"""Append-only sinks and copy-on-write changes of document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_by_date(df: DataFrame, path: str, time: str, target: str, grain: str = "day") -> None:
    """Append rows to a table partitioned by the day or month of ``time``.

    The rebalance hint brings rows of one date together, splits a date that is
    larger than the advisory partition size over several tasks and merges small
    ones, so neither a hot date nor many tiny files result.
    """
    (
        df.withColumn(target, F.to_date(F.date_trunc(grain, time)))
        .hint("rebalance", F.col(target))
        .write.mode("append")
        .partitionBy(target)
        .parquet(path)
    )


def append_history(history: DataFrame, path: str) -> None:
    append_by_date(history, path, "executed_at", "executed_date")


def append_anomalies(anomalies: DataFrame, path: str) -> None:
    append_by_date(anomalies, path, "detected_at", "detected_date")


def append_detections(detections: DataFrame, path: str) -> None:
    """Scan results with every counter kept; few rows per table, hence by month."""
    append_by_date(detections, path, "detected_at", "detected_month", "month")


def write_cards(cards: DataFrame, path: str) -> None:
    """Table cards as JSON lines, compressed."""
    cards.write.mode("overwrite").option("compression", "gzip").json(path)


def card_index(cards: DataFrame) -> DataFrame:
    """Summary of the cards: id, name, schema, table, number of columns."""
    return cards.select("id", "name", "schema", "table", F.size("columns").alias("num_columns"))


def write_card_index(cards: DataFrame, path: str) -> None:
    """The summary as JSON lines beside the cards."""
    card_index(cards).write.mode("overwrite").option("compression", "gzip").json(path)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest-wins merge: per key the row with the highest version; on a tie the update."""
    rest = [c for c in base.columns if c not in keys]
    both = base.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    newest = F.max_by(F.struct(*rest), F.struct(version, "_src")).alias("_doc")
    return both.groupBy(*keys).agg(newest).select(*keys, "_doc.*").select(*base.columns)


def update_if_unchanged(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], version: str, fields: Sequence[str]
) -> DataFrame:
    """Apply updates whose expected version is the stored one; others leave the row as it is.

    Adds ``outcome``: updated, conflict or untouched. ``updates`` holds the
    key, the expected version and the new fields. Of several updates that expect the
    stored version one is applied, the smallest by its fields; ``update_outcomes``
    tells what became of each.
    """
    judged = _judged_updates(base, updates, keys, version, fields)
    new = judged.groupBy(*keys).agg(
        F.min(F.when(F.col("_ok"), F.struct(*[f"_new_{f}" for f in fields]))).alias("_winner"),
        F.lit(True).alias("_asked"),
    )
    joined = base.join(new, list(keys), "left").select("*", "_winner.*").withColumn(
        "outcome",
        F.when(F.col("_asked").isNull(), "untouched")
        .when(F.col("_winner").isNotNull(), "updated")
        .otherwise("conflict"),
    )
    changed = F.col("outcome") == "updated"
    for field in fields:
        joined = joined.withColumn(
            field, F.when(changed, F.coalesce(f"_new_{field}", field)).otherwise(F.col(field))
        )
    joined = joined.withColumn(version, F.when(changed, F.col(version) + 1).otherwise(F.col(version)))
    return joined.select(*base.columns, "outcome")


def _judged_updates(base, updates, keys, version, fields) -> DataFrame:
    """Updates with ``_known`` (the key exists) and ``_ok`` (it has the expected version)."""
    new = updates.select(
        *keys, F.col(version).alias("_expected"), *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    stored = base.select(*keys, F.col(version).alias("_stored"), F.lit(True).alias("_known"))
    ok = F.coalesce(F.col("_expected") == F.col("_stored"), F.lit(False))
    return new.join(stored, list(keys), "left").withColumn("_ok", ok)


def update_outcomes(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], version: str, fields: Sequence[str]
) -> DataFrame:
    """What became of each update: updated, superseded by another one, conflict or unknown key."""
    judged = _judged_updates(base, updates, keys, version, fields)
    asked = F.struct(*[f"_new_{f}" for f in fields])
    winners = judged.where("_ok").groupBy(*keys).agg(F.min(asked).alias("_winner"))
    return judged.join(winners, list(keys), "left").select(
        *keys,
        F.col("_expected").alias("expected_version"),
        *[F.col(f"_new_{f}").alias(f) for f in fields],
        F.when(F.col("_known").isNull(), "unknown")
        .when(~F.col("_ok"), "conflict")
        .when(asked == F.col("_winner"), "updated")
        .otherwise("superseded")
        .alias("outcome"),
    )


def acknowledge(detections: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Mark the given detections acknowledged and stamp the change."""
    marks = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    before = F.col("updated_at") if "updated_at" in detections.columns else F.lit(None)
    return (
        detections.join(marks, key, "left")
        .withColumn("is_acknowledged", F.coalesce("is_acknowledged", F.lit(False)) | hit)
        .withColumn("updated_at", F.when(hit, now).otherwise(before))
        .drop("_hit")
    )


def delete_rows(df: DataFrame, doomed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that remain after deleting by a key set."""
    return df.join(doomed.select(*on), list(on), "left_anti")


def deleted_count(df: DataFrame, doomed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Number of rows a delete removes."""
    return df.join(doomed.select(*on), list(on), "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
