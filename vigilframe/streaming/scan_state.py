"""State of a quality scan that grows batch by batch and merges to the full scan's result.

Three parts, each a set of runs below its folder: NULL counts and category counts, which
add up, and key hashes, of which only the distinct ones count. A batch costs what it holds:
it writes one run per part. Every few batches the runs since the last base are
merged with it into a new base, bucket by bucket of the hash, so a reader meets one base and
a few runs, and files stay few. A batch that is run again overwrites its run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators.quality import (
    COUNTERS,
    category_counts,
    null_counts,
    roll_up,
    shortened,
    with_bands,
)

NULLS = "column_name string, total_records long, null_count long"
CATEGORIES = "column_name string, value string, cnt long"
KEYS = "k1 long, k2 long"


def write_batch(df: DataFrame, path: str, batch: int, kind: str = "batch") -> None:
    df.write.mode("overwrite").parquet(f"{path}/{kind}={batch}")


def merged_nulls(parts: DataFrame) -> DataFrame:
    return parts.groupBy("column_name").agg(
        F.sum("total_records").alias("total_records"), F.sum("null_count").alias("null_count")
    )


def merged_categories(parts: DataFrame) -> DataFrame:
    return parts.groupBy("column_name", "value").agg(F.sum("cnt").alias("cnt"))


def merged_keys(parts: DataFrame) -> DataFrame:
    return parts.distinct()


PARTS = {"nulls": (NULLS, merged_nulls), "categories": (CATEGORIES, merged_categories), "keys": (KEYS, merged_keys)}


def key_hashes(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct 128-bit hashes of the key; NULL parts are values of a composite key, a single NULL is none."""
    rows = df.where(F.col(key[0]).isNotNull()) if len(key) == 1 else df
    # NULL leaves a hash as it is, so places of NULLs are hashed as well.
    parts: list[Column] = [x for c in key for x in (F.col(c).isNull(), F.col(c))]
    return rows.select(
        F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2")
    ).distinct()


class ScanState:
    """Quality scan of one growing table, kept below ``root``."""

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str] = (), compact_every: int = 8
    ):
        self.spark, self.root, self.key, self.compact_every = spark, root, list(key), compact_every
        self.texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]

    # --- folders ------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, part: str, kind: str) -> list[int]:
        """Numbers of the finished runs or bases of a part."""
        fs, path = self._fs()
        folder = path(f"{self.root}/{part}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if fs.exists(path(f"{self.root}/{part}/{kind}={n}/_SUCCESS")))

    def _current(self, part: str) -> tuple[int, list[int]]:
        """Number of the newest base, -1 without one, and the runs after it."""
        base = max(self._numbers(part, "base"), default=-1)
        return base, [n for n in self._numbers(part, "batch") if n > base]

    def read(self, part: str) -> DataFrame:
        """All rows of a part: the newest base and the runs after it, not yet merged."""
        schema = PARTS[part][0]
        base, runs = self._current(part)
        folders = [f"{self.root}/{part}/base={base}"] * (base >= 0) + [f"{self.root}/{part}/batch={n}" for n in runs]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def merged(self, part: str) -> DataFrame:
        return PARTS[part][1](self.read(part))

    # --- growth -------------------------------------------------------------------------

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Add the rows of a batch; the same number again replaces what it added."""
        write_batch(null_counts(batch), f"{self.root}/nulls", number)
        if self.texts:
            short = category_counts(shortened(batch, self.texts), self.texts)
            write_batch(short, f"{self.root}/categories", number)
        if self.key:
            write_batch(key_hashes(batch, self.key), f"{self.root}/keys", number)
        for part in PARTS:
            if len(self._current(part)[1]) >= self.compact_every:
                self.compact(part)

    def compact(self, part: str) -> None:
        """Merge the newest base and the runs after it into a new base, then drop what the base before replaced."""
        before, runs = self._current(part)
        write_batch(self.merged(part), f"{self.root}/{part}", max(runs), "base")
        fs, path = self._fs()
        # One generation stays, for readers that listed it before.
        old = [("base", n) for n in self._numbers(part, "base") if n < before]
        old += [("batch", n) for n in self._numbers(part, "batch") if n <= before]
        for kind, n in old:
            fs.delete(path(f"{self.root}/{part}/{kind}={n}"), True)

    # --- result -------------------------------------------------------------------------

    def counters(self, table_name: str, not_null: Sequence[str] = ()) -> DataFrame:
        """Counters of the full scan, from the merged state."""
        profile = with_bands(self.merged("nulls"), not_null)
        total, zero = F.col("total_records"), F.lit(0).cast("bigint")
        rows = self.merged("nulls").agg(F.max("total_records")).scalar()
        rare = F.col("value").isNotNull() & (F.col("cnt") * 20 < rows)
        values = {
            "total_records": total,
            "null_count": F.col("score"),
            "distribution_count": self.merged("categories").agg(F.count_if(rare)).scalar(),
            "duplicate_count": zero,
        }
        if self.key:
            distinct = self.merged("keys").agg(F.count(F.lit(1))).scalar()
            values["duplicate_count"] = F.greatest(total - distinct, zero)
        return profile.agg(F.max("total_records").alias("total_records"), F.sum("score").alias("score")).select(
            F.lit(table_name).alias("table_name"),
            *[F.coalesce(values[c], zero).cast("bigint").alias(c) for c in COUNTERS],
        )

    def roll_up(self, table_name: str, not_null: Sequence[str] = ()) -> DataFrame:
        """The row that a full scan of all rows absorbed so far gives."""
        return roll_up(self.counters(table_name, not_null))
