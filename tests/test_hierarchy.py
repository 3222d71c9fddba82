"""Paths of parent-child tables, by pointer doubling, against walking upwards."""

import random

from vigilframe.plans import workload


def walked(rows):
    children, out = {}, []
    for i, parent, name in rows:
        children.setdefault(parent, []).append((i, name))
    stack = [(i, 0, name, (i,)) for i, name in children.get(None, [])]
    while stack:
        i, depth, path, seen = stack.pop()
        out.append((i, depth, path))
        stack += [(c, depth + 1, f"{path}/{n}", (*seen, c)) for c, n in children.get(i, []) if c is not None and c not in seen]
    reached = {i for i, *_ in out}
    return sorted(out + [(i, None, None) for i, parent, _ in rows if parent is not None and i not in reached], key=str)


def paths(spark, rows):
    nodes = spark.createDataFrame(rows, "id long, parent_id long, name string")
    return sorted(map(tuple, workload.hierarchy(nodes).collect()), key=str)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    write = workload.written
    monkeypatch.setattr(workload, "written", lambda df, name: rounds.append(name) or write(df, name))
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(1000)]
    random.Random(1).shuffle(rows)
    got = paths(spark, rows)
    assert len(rounds) <= 12
    assert got == walked(rows)


def test_cycles_orphans_and_several_parents(spark):
    rows = [
        (1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (4, 3, "d"), (5, 4, "e"), (6, 99, "orphan"), (7, 6, "below"),
        (8, 9, "x"), (9, 10, "y"), (10, 8, "z"), (11, 9, "hangs"), (12, 12, "self"), (2, 5, "b again"), (13, None, "lone"),
        (None, 1, "nobody"), (14, None, "root"), (15, 14, "p"), (14, 15, "root below"),
    ]
    want = [r for r in walked(rows) if r[0] is not None]
    assert [r for r in paths(spark, rows) if r[0] is not None] == want


def test_random_trees(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, *range(max(0, i - 4), i)]) if i else None, f"n{i}") for i in range(120)]
    assert paths(spark, rows) == walked(rows)
    assert paths(spark, rows[:0]) == []
