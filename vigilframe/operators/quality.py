"""Table quality scan: NULLs, duplicates, category shares, roll-up to a status.

Every ratio test compares integers, so a share of exactly 5 % is never rounded
to either side. A scan reads the table three times whatever its width: once
for all NULL counts, once (key columns only) for key duplicates, once (text
columns only) for all category counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.functions import messages as msg
from vigilframe.functions.scalars import filled
from vigilframe.plans.skew import ROWS_PER_TASK
from vigilframe.session import written

COUNTERS = ["total_records", "null_count", "duplicate_count", "distribution_count"]
LONG_TEXT = 64


def text_columns(df: DataFrame) -> list[str]:
    """Columns whose categories are profiled."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def pct(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage, NULL for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, total_records, null_count), one pass for all columns."""
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)],
    )
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_count"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.col("_total").alias("total_records"), F.inline(F.array(*cells))).select(
        "column_name", "total_records", "null_count"
    )


def null_profile(
    df: DataFrame, not_null: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """NULL count, share, band and score per column."""
    return with_bands(null_counts(df, columns), not_null)


def with_bands(counts: DataFrame, not_null: Sequence[str] = ()) -> DataFrame:
    """NULL counts with their share, band and score, for counts of one scan or of many merged ones.

    Score: rows for a column declared NOT NULL, else 1 below 5 % or from 20 %
    upwards, else 0.
    """
    n, total = F.col("null_count"), F.col("total_records")
    band = (
        F.when(n == 0, "none")
        .when(F.col("declared_not_null"), "not_null_violation")
        .when(n * 100 < total, "rare")
        .when(n * 20 < total, "minority")
        .when(n * 5 < total, "unflagged")
        .otherwise("majority")
    )
    score = (
        F.when(F.col("band") == "not_null_violation", n)
        .when(F.col("band").isin("rare", "minority", "majority"), F.lit(1).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    return (
        counts
        .withColumn("declared_not_null", F.col("column_name").isin(*not_null) if not_null else F.lit(False))
        .withColumn("null_pct", pct(n, total, 4))
        .withColumn("band", band)
        .withColumn("score", score)
    )


def null_details(df: DataFrame, not_null: Sequence[str] = ()) -> DataFrame:
    """One finding per column that holds NULLs, with severity and description."""
    types = F.create_map(
        *[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]
    )
    n, total = F.col("null_count"), F.col("total_records")
    severity = (
        F.when(F.col("declared_not_null") | (n * 100 < total), "high")
        .when(n * 20 < total, "medium")
        .otherwise("low")
    )
    label = (
        F.when(F.col("declared_not_null"), msg.NULL_IN_NOT_NULL)
        .when(n * 100 < total, msg.VERY_FEW_NULLS)
        .when(n * 20 < total, msg.FEW_NULLS)
        .otherwise(msg.MANY_NULLS)
    )
    return (
        null_profile(df, not_null)
        .where(n > 0)
        .select(
            "column_name",
            types[F.col("column_name")].alias("data_type"),
            "declared_not_null",
            n.alias("finding_count"),
            pct(n, total, 2).alias("percentage"),
            severity.alias("severity"),
            F.concat(label, F.lit(" ("), pct(n, total, 1).cast("string"), F.lit("%)")).alias("description"),
        )
    )


def null_samples(df: DataFrame, order: Sequence[str], per_column: int = 5) -> DataFrame:
    """Up to ``per_column`` example rows, as JSON, for each column that holds NULLs."""
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns]))
    w = Window.partitionBy("column_name").orderBy(*[f"_row.{c}" for c in order])
    return (
        df.select(F.explode(empty).alias("column_name"), F.struct(*df.columns).alias("_row"))
        .withColumn("sample_no", F.row_number().over(w))
        .where(F.col("sample_no") <= per_column)
        .select("column_name", "sample_no", F.to_json("_row").alias("sample_row"))
    )


def key_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Surplus rows over distinct keys.

    A composite key is compared as a row value, so keys with NULL parts are
    values of their own; a single-column key ignores NULLs when counting
    distinct values, so NULL keys count as surplus.
    """
    if not key:
        return df.limit(0).agg(F.count(F.lit(1)).alias("duplicate_count"))
    distinct = F.count_distinct(F.col(key[0]) if len(key) == 1 else F.struct(*key))
    return df.agg(F.greatest(F.count(F.lit(1)) - distinct, F.lit(0).cast("bigint")).alias("duplicate_count"))


def duplicate_row_groups(df: DataFrame) -> DataFrame:
    """Groups of identical rows with their size.

    The first shuffle carries one 64-bit hash per row, combined map-side; whole
    rows are moved only for hashes seen twice or more, and equal hashes of
    different rows are told apart by grouping on all columns. Rows of a hash seen more often
    than a task should hold are not dealt by it but counted where they lie; such hashes are
    few by their size, so their list is broadcast.
    """
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    repeated = written(repeated, "repeated-hashes")
    hot = F.broadcast(repeated.where(F.col("_n") > ROWS_PER_TASK).select("_h"))
    rest = repeated.where(F.col("_n") <= ROWS_PER_TASK).select("_h")
    counted = lambda rows: rows.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("finding_count"))
    few = counted(hashed.join(hot, "_h", "left_anti").join(rest, "_h", "left_semi"))
    return few.unionByName(counted(hashed.join(hot, "_h", "left_semi"))).where(F.col("finding_count") > 1)


def duplicate_rows(df: DataFrame, top: int = 5) -> DataFrame:
    """Largest groups of identical rows with severity."""
    ties = [F.col(c) for c in df.columns]
    return (
        duplicate_row_groups(df)
        .withColumn("severity", F.when(F.col("finding_count") <= 3, "medium").otherwise("high"))
        .orderBy(F.desc("finding_count"), *ties)
        .limit(top)
    )


def category_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, cnt) for all text columns in one pass."""
    columns = list(text_columns(df) if columns is None else columns)
    return (
        df.select(*columns)
        .unpivot([], columns, "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def category_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Category counts with their share of all rows, NULLs included in the base."""
    total = row_count(df).scalar()
    return category_counts(df, columns).select(
        "column_name", "value", "cnt", pct(F.col("cnt"), total, 4).alias("share_pct")
    )


def shortened(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns with long texts replaced by their digest, for counting."""
    return df.select(
        *[F.when(F.length(c) < LONG_TEXT, F.col(c)).otherwise(F.sha2(F.col(c), 256)).alias(c) for c in columns]
    )


def rare_category_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-NULL values with a share below 5 %, counted per column.

    Only the number of rare values is needed, so a long text travels through
    the shuffle as its SHA-256 digest (64 characters, longer than any value
    kept as is).
    """
    columns = list(text_columns(df) if columns is None else columns)
    if not columns:
        return df.limit(0).select(
            F.lit("").alias("column_name"), F.lit(0).cast("bigint").alias("rare_count")
        )
    total = row_count(df).scalar()
    rare = F.col("value").isNotNull() & (F.col("cnt") * 20 < total)
    return (
        category_counts(shortened(df, columns), columns)
        .groupBy("column_name")
        .agg(F.count_if(rare).alias("rare_count"))
    )


def dominant_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column; flagged from a share of 90 % among several groups."""
    known = F.col("value").isNotNull()
    per_column = category_counts(df, columns).groupBy("column_name").agg(
        F.sum("cnt").alias("total_records"),
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.when(~known, F.col("cnt"))), F.lit(0).cast("bigint")).alias("null_count"),
        F.max_by("value", F.when(known, F.struct("cnt", "value"))).alias("top_value"),
        F.coalesce(F.max(F.when(known, F.col("cnt"))), F.lit(0).cast("bigint")).alias("top_count"),
    )
    flag = (F.col("groups") > 1) & (F.col("top_count") * 10 >= F.col("total_records") * 9)
    return per_column.withColumn("is_dominant", flag)


def dominant_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The value with at least 90 % of all rows per text column, or NULL; flagged if others exist.

    A value that most rows hold also owns the majority of every bit of the values' hashes. So
    one pass with 64 counts per column names the only possible value by its hash, and mostly
    rules it out; a second pass counts the rows with that hash value by value. Unlike
    ``dominant_values``, no distinct value but those of one hash per column is shuffled.
    Columns of an empty table get no row.
    """
    columns = list(text_columns(df) if columns is None else columns)
    long = df.select(*columns).unpivot([], columns, "column_name", "value")
    long = long.withColumn("_h", F.when(F.col("value").isNotNull(), F.xxhash64("value")))
    ones = [F.coalesce(F.sum(F.getbit("_h", F.lit(i)).cast("bigint")), F.lit(0)).alias(f"_b{i}") for i in range(64)]
    stats = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_records"), F.count("_h").alias("_n"), *ones
    )
    bits = [F.col(f"_b{i}") for i in range(64)]
    possible = reduce(
        and_, [F.greatest(b, F.col("_n") - b) * 10 >= F.col("total_records") * 9 for b in bits]
    )
    majority = F.concat(*[F.when(b * 2 > F.col("_n"), "1").otherwise("0") for b in reversed(bits)])
    candidates = stats.where(possible).select("column_name", majority.alias("_bits"))
    as_bits = F.lpad(F.bin("_h"), 64, "0")
    # At most one row per column of the table.
    found = (
        long.where("_h is not null")
        .join(F.broadcast(candidates), "column_name")
        .where(as_bits == F.col("_bits"))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("column_name")
        .agg(F.max_by("value", F.struct("cnt", "value")).alias("_v"), F.max("cnt").alias("_c"))
    )
    held = F.col("_c") * 10 >= F.col("total_records") * 9
    return stats.join(F.broadcast(found), "column_name", "left").select(
        "column_name",
        "total_records",
        (F.col("total_records") - F.col("_n")).alias("null_count"),
        F.when(held, F.col("_v")).alias("dominant_value"),
        F.when(held, F.col("_c")).alias("dominant_count"),
        F.coalesce(held & (F.col("_c") < F.col("total_records")), F.lit(False)).alias("is_dominant"),
    )


def distribution_details(df: DataFrame, columns: Sequence[str] | None = None, rarest: int = 10) -> DataFrame:
    """The rarest values per column, kept where their share is below 5 %."""
    total = row_count(df).scalar()
    w = Window.partitionBy("column_name").orderBy("cnt", "value")
    share = F.coalesce(pct(F.col("cnt"), total, 1), F.lit(0.0)).cast("string")
    return (
        category_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("rarity", F.row_number().over(w))
        .where(F.col("rarity") <= rarest)
        .where(F.col("cnt") * 20 < total)
        .select(
            "column_name",
            "value",
            F.col("cnt").alias("finding_count"),
            pct(F.col("cnt"), total, 2).alias("percentage"),
            F.when(F.col("cnt") * 100 < total, "high").otherwise("medium").alias("severity"),
            filled(msg.RARE_VALUE, value=F.col("value"), n=F.col("cnt"), share=share).alias("description"),
        )
    )


def status_of(anomalies: Column, total: Column) -> Column:
    """normal / info / warning / error from 1 %, 5 % and 10 % of all rows."""
    return (
        F.when(total == 0, "normal")
        .when(anomalies * 10 >= total, "error")
        .when(anomalies * 20 >= total, "warning")
        .when(anomalies * 100 >= total, "info")
        .otherwise("normal")
    )


def _counter_row(df: DataFrame, table_name: str, **given: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.select(
        F.lit(table_name).alias("table_name"),
        *[F.coalesce(given.get(c, zero), zero).cast("bigint").alias(c) for c in COUNTERS],
    )


def scan_counters(
    df: DataFrame, table_name: str, key: Sequence[str] = (), not_null: Sequence[str] = ()
) -> DataFrame:
    """Additive counters of one table, one row per kind of check."""
    nulls = null_profile(df, not_null).agg(
        F.max("total_records").alias("t"), F.sum("score").alias("n")
    )
    parts = [_counter_row(nulls, table_name, total_records=F.col("t"), null_count=F.col("n"))]
    if key:
        parts.append(_counter_row(key_duplicates(df, key), table_name, duplicate_count=F.col("duplicate_count")))
    if text_columns(df):
        rare = rare_category_counts(df).agg(F.sum("rare_count").alias("r"))
        parts.append(_counter_row(rare, table_name, distribution_count=F.col("r")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def roll_up(counters: DataFrame) -> DataFrame:
    """Sum counters per table and classify the table."""
    summed = counters.groupBy("table_name").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    anomalies = F.col("null_count") + F.col("duplicate_count") + F.col("distribution_count")
    return summed.withColumn("anomaly_count", anomalies).withColumn(
        "status", status_of(F.col("anomaly_count"), F.col("total_records"))
    )


def scan_table(
    df: DataFrame, table_name: str, key: Sequence[str] = (), not_null: Sequence[str] = ()
) -> DataFrame:
    """Quality scan of one table: counters, their sum and a status."""
    return roll_up(scan_counters(df, table_name, key, not_null))


def findings(
    df: DataFrame, not_null: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """NULL, duplicate and distribution findings of one table as one list."""
    nulls = null_details(df, not_null).select(
        F.lit("null_values").alias("finding_type"), "column_name", "finding_count",
        "percentage", "severity", "description",
    )
    repeated = duplicate_rows(df).select(
        F.lit("duplicates").alias("finding_type"), "finding_count", "severity",
        filled(msg.DUPLICATE, n=F.col("finding_count")).alias("description"),
    )
    rare = distribution_details(df, columns).withColumn("finding_type", F.lit("distribution_anomaly"))
    return nulls.unionByName(repeated, allowMissingColumns=True).unionByName(rare, allowMissingColumns=True)
