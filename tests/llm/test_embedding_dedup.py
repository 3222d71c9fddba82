import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import embedding_dedup
from vigilframe.llm.common import QUERIES

from .conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, limit=0.98):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        x /= np.abs(x).max()
        return x / np.sqrt(x @ x)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    groups, parent, links = {}, list(range(len(rows))), [0] * len(rows)
    for i, u in enumerate(units):
        if u is not None:
            groups.setdefault((rows[i][2], len(u)), []).append(i)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for group in groups.values():
        stacked = np.array([units[i] for i in group])
        near = stacked @ stacked.T >= limit
        for x, y in zip(*np.nonzero(np.triu(near, 1))):
            i, j = group[x], group[y]
            links[i] += 1
            links[j] += 1
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    component = [least.get(root(i)) for i in range(len(rows))]
    return sorted(
        [(r[0], links[i], component[i], None if None in (r[0], component[i]) else r[0] == component[i]) for i, r in enumerate(rows)], key=str
    )


def found(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def clustered(seed, n, dims, spread, labels=3, clusters=12):
    """Vectors around few centres at distances near the limit, with copies and scaled copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    at = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))
    at[n // 2 : n // 2 + n // 8] = at[: n // 8]
    at[n // 2 + n // 8 : n // 2 + n // 6] = 2 * at[: n // 6 - n // 8]
    label = rng.integers(0, labels, n)
    label[n // 2 : n // 2 + n // 8] = label[: n // 8]
    ids = rng.permutation(n)
    return [(int(i), [float(np.float32(x)) for x in v], int(g)) for i, v, g in zip(ids, at, label)]


@pytest.mark.parametrize("dims,spread", [(64, 0.1), (64, 0.14), (10, 0.12), (3, 0.02), (2, 0.002), (1, 0.1)])
def test_against_all_pairs(spark, dims, spread):
    rows = clustered(dims, 500, dims, spread)
    assert found(embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("limit,blocks", [(0.9, 8), (0.99, 1), (0.5, 3)])
def test_other_limits_and_blocks(spark, limit, blocks):
    rows = clustered(4, 300, 24, 0.3)
    assert found(embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), limit, blocks)) == brute(rows, limit)


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_cut_cells_and_finer_grids(spark, axes, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "grid_axes", lambda rows: axes)
    rows = clustered(9, 600, 16, 0.1, labels=1, clusters=3)
    assert found(embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_pigeonhole_never_loses_a_pair():
    """Every pair within the limit lies within the budget of a block, and meets in exactly one cell of it."""
    rng = np.random.default_rng(3)
    space = embedding_dedup.Subspaces(32, grid=2)
    x = rng.normal(size=(200, 32))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.13])
    points = space.points(x).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = np.triu(unit @ unit.T >= 0.98, 1)
    assert 20 < close.sum() < 200
    caught = np.zeros_like(close)
    for block in range(len(space.cuts)):
        near = space.block_distances(points, points, block) <= space.budgets[block]
        caught |= near
        homes, visits = {}, {}
        for rows, cells, home in space.cells(points.astype(np.int16), block):
            for r, c in zip(rows, cells):
                (homes if home else visits).setdefault(r, set()).add(c)
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            together = (homes[i] & homes[j]) | (homes[i] & visits.get(j, set())) | (homes[j] & visits.get(i, set()))
            assert len(together) == 1
    assert (caught >= close).all()


def test_near_copies_give_no_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(i, [float(x) for x in centre + 0.05 * rng.normal(size=64)], 1) for i in range(1500)]
    keyed = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "size(embedding) as dims", "xxhash64(embedding) as k1", "vec_id as k2"
    )
    kinds = embedding_dedup.findings(embedding_dedup.cell_rows(embedding_dedup.vector_classes(keyed)))
    sizes = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    assert kinds.where("kind = 0").agg(F.sum("b")).first()[0] == 1500 * 1499
    assert sizes[0] + sizes[1] + sizes.get(2, 0) < 30 * 1500


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1),
        (None, [1.0, 0.01], 1), (None, [0.0, -1.0], 5), (None, [0.0, -1.0], 5), (11, [-1.0, 0.0], 1), (12, [-1.0, -0.0], 1),
        (13, [1.0, 0.0, 0.0], 1), (14, [1e38, 0.0], 1), (15, [1e-40, 0.0], 1), (-5, [1.0, 0.2], 1), (16, [5.0], 1), (17, [-5.0], 1),
    ]
    data = spark.createDataFrame(rows, SCHEMA)
    assert found(embedding_dedup.near_duplicates(data)) == brute(rows)
    clash = {n: F.lit("clash") for n in ("dims", "k1", "node", "members", "root", "block", "cell", "_c0", "first_id")}
    again = embedding_dedup.near_duplicates(data.withColumns(clash | {"kept": F.lit("old")}))
    assert again.columns == [*SCHEMA.replace(" long", "").replace(" array<float>", "").replace(" int", "").split(", "),
                             *clash, "n_links", "component_id", "kept"]
    assert found(again) == brute(rows)
    assert again.select(*clash).distinct().count() == 1
    assert embedding_dedup.near_duplicates(data.limit(0)).count() == 0
    doubles = spark.createDataFrame(rows[:3], "vec_id int, embedding array<double>, label long")
    assert [r[1] for r in found(embedding_dedup.near_duplicates(doubles))] == [2, 2, 2]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(QUERIES["op13_embedding_dedup"](spark, DATA)) == brute(rows)
