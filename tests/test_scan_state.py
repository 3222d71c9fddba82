"""A scan absorbed in batches gives the row of the full scan."""

import random
from pathlib import Path
from types import SimpleNamespace

import pytest

from vigilframe.operators import quality
from vigilframe.session import new_table_path
from vigilframe.streaming.scan_state import ScanState
from vigilframe.suite import streaming


@pytest.mark.parametrize("key,not_null,every", [(["a", "b"], [], 2), (["a"], ["b"], 3), ([], ["a"], 100)])
def test_batches_add_up_to_the_full_scan(spark, key, not_null, every):
    rng = random.Random(every)
    rows = [
        (rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 5, 6]), "x" if rng.random() < 0.97 else "rare", rng.choice(["long " * 40, None]))
        for _ in range(400)
    ]
    schema = "a long, b long, t string, u string"
    df = spark.createDataFrame(rows, schema)
    state = ScanState(spark, new_table_path(spark, "state"), df.schema, key, every)
    for number in range(7):
        batch = spark.createDataFrame(rows[number * 50 : number * 50 + 50 if number < 6 else None], schema)
        state.absorb(batch, number)
        if number in (2, 6):
            state.absorb(batch, number)  # after a failure the same batch comes again
        sofar = spark.createDataFrame(rows[: number * 50 + 50 if number < 6 else None], schema)
        if number in (0, 3, 6):
            want = quality.scan_table(sofar, "t", key, not_null).collect()
            assert state.roll_up("t", not_null).collect() == want


def test_old_runs_are_merged_and_dropped(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(20)], "a long")
    state = ScanState(spark, new_table_path(spark, "state"), df.schema, ["a"], 2)
    for number in range(9):
        state.absorb(df, number)
    base, runs = state._current("keys")
    assert base == 7 and runs == [8]
    kept = sorted(p.name for p in Path(f"{state.root}/keys").iterdir())
    assert kept == ["base=5", "base=7", "batch=6", "batch=7", "batch=8"]
    assert state.read("keys").count() == 6 and state.merged("keys").count() == 3
    (row,) = state.roll_up("t").collect()
    assert (row["total_records"], row["duplicate_count"]) == (180, 177)


def test_nothing_absorbed(spark):
    df = spark.createDataFrame([], "a long, t string")
    state = ScanState(spark, new_table_path(spark, "state"), df.schema, ["a"])
    assert state.merged("nulls").count() == 0 and state.merged("keys").count() == 0
    state.absorb(df, 0)
    assert state.roll_up("t").first()["total_records"] == 0


def test_a_batch_of_many_rows_arrives_in_several_files(spark, monkeypatch):
    """Four batches whatever the size, but no task reads or writes a whole batch of a large table."""
    monkeypatch.setattr(streaming, "ROWS_PER_TASK", 50)
    seen, paths = [], streaming.J.paths

    def recorded(*a):
        seen.append(paths(*a))
        return seen[-1]

    monkeypatch.setattr(streaming.J, "paths", recorded)
    table = spark.range(400).selectExpr("id", "IF(id % 2 = 0, 'x', NULL) AS t")
    state = streaming._scanned(SimpleNamespace(spark=spark, table=table), "table", ["id"])
    rows = [spark.read.parquet(str(f)).count() for f in Path(seen[0][0]).glob("part-*")]
    assert sum(rows) == 400 and len(rows) == 8 and max(rows) <= 60
    assert len(state._numbers("nulls", "batch")) == 4
    counted = {r["column_name"]: (r["total_records"], r["null_count"]) for r in state.merged("nulls").collect()}
    assert counted == {"id": (400, 0), "t": (400, 200)} and state.merged("keys").count() == 400
