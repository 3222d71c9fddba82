"""Quality scan of many tables as one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from vigilframe.operators.quality import roll_up, scan_counters


def scan_tables(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    not_null: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One result row per table; counters of all tables meet in one small shuffle."""
    not_null = not_null or {}
    counters = None
    for name, df in tables.items():
        part = scan_counters(df, name, keys.get(name, ()), not_null.get(name, ()))
        counters = part if counters is None else counters.unionByName(part)
    return roll_up(counters)
