"""Registration of queries and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from urllib.parse import urlparse

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.session import new_table_path, shared_folder, written

__all__ = ["new_table_path", "shared_folder", "written"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Python workers get batches of this many rows and bytes at most, so that a batch of
# long texts stays small beside a worker's memory.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def query(name: str, sql: str | None = None):
    """Register a function of (session, data folder) under ``name``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keeps_columns(*plain: str):
    """For functions from rows to some of the rows: all columns come back, in order.

    Columns other than ``plain`` travel under numbers, so none can clash with names that
    the function uses itself.
    """

    def wrap(fn: Callable[..., DataFrame]):
        @wraps(fn)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            numbers = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c not in plain}
            out = fn(docs.withColumnsRenamed(numbers), *args, **options)
            return out.select(*[F.col(f"`{numbers.get(c, c)}`").alias(c) for c in docs.columns])

        return run

    return wrap


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_bucket(column: str, n: int) -> Column:
    """CRC-32 of an id as text, modulo ``n``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder that all executors share; works inside tasks."""
    if not urlparse(uri).scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def text_groups(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in groups of about ``limit`` bytes, with the first one's place."""
    first, size, group = 0, 0, []
    for i, text in enumerate(texts):
        if group and size + len(text) > limit:
            yield first, group
            first, size, group = i, 0, []
        group.append(text)
        size += len(text)
    if group:
        yield first, group
