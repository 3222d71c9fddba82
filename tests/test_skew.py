"""Bucketed windows, salted joins and bracketed percentiles against plain computation.

Half of all rows belong to one key and many times are tied.
"""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilframe.plans import skew, workload
from vigilframe.operators import history, outliers


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 6000
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    hours = rng.integers(0, 24 * 20, n)
    return pd.DataFrame(
        {
            "key": key.astype("int64"),
            "id": np.arange(n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"),
            "v": np.round(rng.normal(100, 20, n), 1),
        }
    ).sort_values(["key", "ts", "id"], ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(7)


def by_id(frame, column):
    return frame.select("id", column).toPandas().set_index("id")[column].sort_index()


def day():
    return F.date_trunc("day", "ts")


def test_lag_across_buckets(df, data):
    got = by_id(skew.lag_in_buckets(df, ["key"], ["ts", "id"], day(), {"v": "prev"}), "prev")
    want = data.assign(prev=data.groupby("key")["v"].shift()).set_index("id")["prev"].sort_index()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_index_and_previous_rows(df, data):
    indexed = skew.index_in_buckets(df, ["key"], ["ts", "id"], day(), "i")
    position = data.groupby("key").cumcount()
    position.index = data["id"]
    pd.testing.assert_series_equal(by_id(indexed, "i"), position.sort_index(), check_names=False)
    for block in (24, 50, 100000):
        stats = skew.previous_rows_stats(indexed, ["key"], "i", "v", 24, block_rows=block)
        assert stats.count() == len(data)
        want = data.groupby("key")["v"].transform(lambda s: s.shift().rolling(24, min_periods=1).mean())
        want.index = data["id"]
        pd.testing.assert_series_equal(by_id(stats, "prev_mean"), want.sort_index(), check_names=False)


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_exact_percentiles(df, data, accuracy):
    got = skew.exact_percentiles(df, ["key"], "v", [0.1, 0.25, 0.5, 0.9], accuracy).toPandas().set_index("key").sort_index()
    want = data.groupby("key")["v"].quantile([0.1, 0.25, 0.5, 0.9]).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("bracket,limit", [(0.0, 10**6), (3.0, 10)])
def test_percentiles_of_one_key(spark, bracket, limit, monkeypatch):
    """Brackets too narrow for the sketch, and more values in a bracket than a task should hold."""
    monkeypatch.setattr(skew, "BRACKET", bracket)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", limit)
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.lognormal(0, 8, 5000), -rng.lognormal(0, 8, 2000), np.zeros(500)])
    rows = [(None if i % 9 else 1, float(v)) for i, v in enumerate(rng.permutation(values))]
    df = spark.createDataFrame(rows, "key int, v double").repartition(6)
    got = {r["key"]: list(r)[1:] for r in skew.exact_percentiles(df, ["key"], "v", [0.01, 0.25, 0.5, 0.997], 60).collect()}
    for key in (None, 1):
        want = np.quantile([v for k, v in rows if k == key], [0.01, 0.25, 0.5, 0.997])
        np.testing.assert_allclose(got[key], want, rtol=1e-12)


def test_percentiles_of_tiny_and_constant_groups(spark):
    rows = [(n, float(i)) for n in range(1, 12) for i in range(n)] + [(99, 5.0)] * 500
    df = spark.createDataFrame(rows, "key int, v double")
    got = skew.exact_percentiles(df, ["key"], "v", [0.0, 0.25, 0.75, 1.0]).toPandas().set_index("key").sort_index()
    want = df.toPandas().groupby("key")["v"].quantile([0.0, 0.25, 0.75, 1.0]).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("rows_per_task", [50, 10**6])
@pytest.mark.parametrize("counted", [True, False])
def test_lookup_join_keeps_every_row_once(df, data, rows_per_task, counted):
    totals = df.groupBy("key").agg(F.sum("v").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = "n" if counted else None
    joined = skew.lookup_join(df, totals, ["key"], ["id"], rows=rows, rows_per_task=rows_per_task)
    assert joined.count() == len(data)
    want = data.groupby("key")["v"].transform("sum")
    want.index = data["id"]
    np.testing.assert_allclose(by_id(joined, "t").to_numpy(), want.sort_index().to_numpy())


def test_lookup_join_with_missing_keys_and_several_rows(spark):
    left = spark.createDataFrame([(i % 3 if i % 4 else None, i) for i in range(200)], "k int, id int")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k int, v string")
    got = skew.lookup_join(left, right, ["k"], ["id"], rows_per_task=10)
    want = left.join(right, "k", "left").select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_keys_are_split(spark):
    """With a small limit the rows of one key meet the join in many partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        left = spark.range(20000).select(F.lit(1).alias("k"), F.col("id"))
        right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
        sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = skew.lookup_join(left, right, ["k"], ["id"], rows="n", sized=sizes, rows_per_task=500)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 20000 and len(sizes) > 10
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_buckets_get_finer_for_hot_keys(df):
    unit = lambda rows, n: str(skew.bucketed(rows, ["key"], ["ts", "id"], n)[1])
    assert "day" in unit(df, 10**6) and "hour" in unit(df, 60) and skew.PART in unit(df.where("id < 60").withColumn("ts", F.current_timestamp()), 1)


@pytest.mark.parametrize("limit", [3, 10**6])
def test_windows_over_ranges_equal_those_over_days(df, data, limit, monkeypatch):
    """With three rows a task, no unit of time is fine enough and ranges take over."""
    monkeypatch.setattr(skew.bucketed, "__defaults__", (limit,))
    cut = skew.cut_ranges
    monkeypatch.setattr(skew, "cut_ranges", lambda df, keys, order, parts: cut(df, keys, order, 12))
    events = df.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "ts", (F.col("id") % 3).cast("string").alias("event_type"))
    steps = workload.session_steps(events, 90)
    assert set(steps.columns) == {"user_id", "session_start", "ts", "event_id", "event_type", "previous_type"}
    starts = steps.select("user_id", "session_start").distinct().groupBy("user_id").count().toPandas()
    gap = data.groupby("key")["ts"].diff()
    want = (gap.isna() | (gap > pd.Timedelta(minutes=90))).groupby(data["key"]).sum()
    assert starts.set_index("user_id")["count"].sort_index().tolist() == want.sort_index().tolist()
    changed = data.assign(t=data["id"] % 3)
    before = changed.groupby("key")["t"].shift()
    assert workload.change_history(events).count() == int((before.notna() & (before != changed["t"])).sum())
    runs = df.select(F.col("key").alias("k"), F.col("id").alias("history_id"), F.col("ts").alias("executed_at"))
    gaps = history.run_gaps(runs, ["k"])
    assert gaps.columns == ["k", "history_id", "executed_at", "previous_executed_at", "gap_seconds"]
    assert gaps.agg(F.sum("gap_seconds")).first()[0] == int(gap.dt.total_seconds().sum())
    far = outliers.adaptive_threshold(df, ["key"], ["ts", "id"], "v", 24, 2.0)
    mean = data.groupby("key")["v"].transform(lambda s: s.shift().rolling(24).mean())
    sd = data.groupby("key")["v"].transform(lambda s: s.shift().rolling(24).std())
    assert far.count() == int(((data["v"] - mean).abs() > 2 * sd).sum())


def test_shares_add_up(df):
    counts = df.groupBy("key", F.floor("v").alias("b")).agg(F.count(F.lit(1)).alias("cnt"))
    shares = history.with_share(counts, ["key"], "cnt", digits=10).groupBy("key").agg(F.sum("share_pct").alias("s"))
    assert shares.where(F.abs(F.col("s") - 100) > 1e-6).count() == 0


@pytest.mark.parametrize("minutes", [0, 60, 60 * 30])
def test_session_starts_across_buckets(df, data, minutes):
    gap = F.make_dt_interval(mins=F.lit(minutes))
    got = skew.sessions_in_buckets(df, ["key"], ["ts", "id"], gap, day(), {"id": "prev_id"})
    assert got.count() == len(data)
    pause = data.groupby("key")["ts"].diff()
    start = pause.isna() | (pause > pd.Timedelta(minutes=minutes))
    opened = data["ts"].where(start).groupby(data["key"]).ffill()
    before = data.groupby("key")["id"].shift().where(~start)
    opened.index = before.index = data["id"]
    assert by_id(got, "session_start").tolist() == opened.sort_index().tolist()
    pd.testing.assert_series_equal(
        by_id(got, "prev_id").astype("float64"), before.sort_index(), check_names=False
    )


def test_sessions_against_pandas(df, data):
    events = df.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "ts", F.lit("x").alias("event_type"))
    got = workload.session_summary(events, 90).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).toPandas()
    gap = data.groupby("key")["ts"].diff()
    want = ((gap.isna()) | (gap > pd.Timedelta(minutes=90))).groupby(data["key"]).sum()
    assert got.set_index("user_id")["n"].sort_index().tolist() == want.sort_index().tolist()


def test_zscore_of_constant_key_has_no_outliers(spark):
    df = spark.createDataFrame([("a", i, 5.0) for i in range(20)], "k string, id int, v double")
    assert outliers.zscore_outliers(df, ["k"], "id", "v").count() == 0


def test_top_k_is_stable_under_repartitioning(df):
    one = skew.newest_per_key(df, ["key"], [F.desc("ts"), F.desc("id")], 5).select("key", "id", "rn")
    two = skew.newest_per_key(df.repartition(3, "v"), ["key"], [F.desc("ts"), F.desc("id")], 5).select("key", "id", "rn")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_change_rate_edge_cases(spark):
    rows = [
        ("t", "zero", "1", "2024-01-01", 0.0), ("t", "zero", "2", "2024-01-02", 5.0),
        ("t", "down", "3", "2024-01-01", 200.0), ("t", "down", "4", "2024-01-02", 150.0),
        ("t", "one", "5", "2024-01-01", 1.0),
        ("t", "tie", "6", "2024-01-01", 1.0), ("t", "tie", "7", "2024-01-01", 2.0),
    ]
    h = spark.createDataFrame(rows, "tenant_id string, metric_id string, history_id string, d string, result_value double")
    h = h.withColumn("executed_at", F.col("d").cast("timestamp_ntz"))
    got = {r["metric_id"]: (r["change_rate"], r["change_label"]) for r in history.latest_and_previous(h).collect()}
    assert got["zero"][0] is None and got["one"][0] is None
    assert got["down"] == (-25.0, "-25.0%") and got["tie"] == (100.0, "+100.0%")
    chart = {r["metric_id"]: r["change_rate"] for r in history.chart_change(h).collect()}
    assert chart["zero"] == 0.0


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("backward", [False, True])
def test_range_scan_agrees_with_a_loop(spark, parts, backward):
    rng = random.Random(parts)
    data = [
        (rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, 1, 1, 1, 2]), rng.choice([None, rng.randrange(99)]))
        for _ in range(600)
    ]
    rows = skew.cut_ranges(spark.createDataFrame(data, "k string, t int, v long").repartition(3), ["k"], ["t"], parts)
    folds = {n: (n, "v") for n in ("count", "sum", "xor", "max", "newest", "lag")}
    per_key = {}
    for r in skew.scan_ranges(rows, ["k"], ["t"], folds, backward).collect():
        per_key.setdefault(r["k"], []).append(r)
    assert sum(map(len, per_key.values())) == len(data)
    for found in per_key.values():
        found.sort(key=lambda r: (r["t"] is not None, r["t"] or 0, r["_tie"]), reverse=backward)
        n, total, xor, most, newest, previous = 0, None, None, None, None, None
        for r in found:
            v = r["v"]
            if v is not None:
                n, total, xor = n + 1, (total or 0) + v, (xor or 0) ^ v
                most, newest = v if most is None else max(most, v), v
            assert tuple(r[f] for f in folds) == (n, total, xor, most, newest, previous)
            previous = v


def test_ranges_share_one_key_with_one_time(spark):
    data = spark.range(4000).selectExpr("1 as k", "timestamp'2024-01-01' as t", "id as v")
    rows = skew.cut_ranges(data, ["k"], ["t"], 20)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 4000 / 20
    last = skew.scan_ranges(rows, ["k"], ["t"], {"n": ("count", "v"), "s": ("sum", "v")}).orderBy("n").tail(1)[0]
    assert (last["n"], last["s"]) == (4000, 4000 * 3999 // 2)
