"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one and rotated at random, which spreads every difference
evenly. A cosine of ``c`` is a squared distance of ``2 - 2c``; cut into blocks of
dimensions, two vectors so close lie, in one block at least, within that block's share
of the squared distance, in proportion to its dimensions. Each block is joined on its own
as a range join: a grid over the block's first dimensions gives every vector one home cell, and
it visits the lower cells that its radius touches, so each close pair meets in one
cell, the lower one of the two homes.

What moves are not vectors but points: 16 bits per rotated dimension. Points decide the
pigeonhole by exact integers, so all tasks agree, and a pair is judged only in the first
block that finds it: counts need no list of pairs. The rounding of points is bounded, so
most pairs are linked or not for certain; the few within the rounding of the limit are
verified by the cosine of the original vectors in double precision.

Cells of many rows are cut into parts, and every two parts meet in a task of their own.
Groups of near copies give counts and a spanning set of links per task, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import query, small_batches, table, written
from vigilframe.llm.components import component_labels
from vigilframe.plans.skew import lookup_join

LIMIT = 0.98
BLOCKS = 4
SEED = 13
# A unit of a point's coordinates; a coordinate of 1.0 still fits 16 bits.
UNIT = 2.0**-14
# Cells of about this size are aimed at when the grid's dimensions are chosen; larger ones are cut into parts.
CELL_ROWS = 4096
GRID_MOST = 5
# Pairs of a cell are compared in strips of this many rows.
STRIP = 256
# A key with more rows than this is split where rows meet their class.
ROWS_PER_TASK = 100_000
CLASS = ["label", "dims", "k1", "k2"]


class Subspaces:
    """Rotation, blocks and radii for vectors of ``dims`` dimensions; lengths are in units of a point."""

    def __init__(self, dims: int, limit: float = LIMIT, blocks: int = BLOCKS, grid: int = 1, seed: int = SEED):
        random = np.random.default_rng([seed, dims])
        self.rotation = np.linalg.qr(random.normal(size=(dims, dims)))[0]
        self.cuts = np.array_split(np.arange(dims), min(blocks, dims))
        self.distance = math.sqrt(max(2 - 2 * limit, 0)) / UNIT
        # Rounding moves a point by half a unit a dimension at most, and floating point by far less.
        self.slack = 0.5 * math.sqrt(dims) + 1e-3
        reach = (self.distance + 2 * self.slack) ** 2
        # Squared budgets, as integers: in proportion to dimensions, rounded up.
        self.budgets = [math.ceil(reach * len(c) / dims) for c in self.cuts]
        self.grid = [min(grid, len(c)) for c in self.cuts]

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated unit vectors in whole units."""
        # Dividing by the largest part first keeps squares of huge and tiny numbers finite.
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        return np.rint(unit @ self.rotation / UNIT).astype(np.int16)

    def cells(self, points: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, cell, home): the home cell of every point, then each lower cell that its radius touches."""
        axes, radius = self.grid[block], math.sqrt(self.budgets[block]) + 1e-6
        side = 2 * radius
        place = points[:, self.cuts[block][:axes]].astype(np.float64)
        home = np.floor(place / side).astype(np.int64)
        inside = place - home * side
        yield np.arange(len(points)), _cell_number(home), True
        for step in product((-1, 0, 1), repeat=axes):
            if step < (0,) * axes:
                away = [inside[:, i] if s < 0 else side - inside[:, i] for i, s in enumerate(step) if s]
                rows = np.flatnonzero(sum(a * a for a in away) <= radius * radius)
                yield rows, _cell_number(home[rows] + np.array(step)), False

    def block_distances(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Squared distances between all rows, exact: whole numbers below 2 ** 53."""
        x, y = a[:, self.cuts[block]], b[:, self.cuts[block]]
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def _cell_number(cell: np.ndarray) -> np.ndarray:
    """Twelve bits per axis; places that wrap around only bring far points together, whose distances tell them apart."""
    number = np.zeros(len(cell), np.int64)
    for i in range(cell.shape[1]):
        number = (number << 12) | (cell[:, i] & 0xFFF)
    return number


def grid_axes(rows: int) -> int:
    """Dimensions of the grid: each leaves about a third of the rows in a cell."""
    return min(GRID_MOST, max(1, math.ceil(math.log(max(rows, 1) / CELL_ROWS, 3)))) if rows else 1


def _labels_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number reachable for the rows and the columns of a 0/1 matrix, numbered one after the other."""
    n, m = near.shape
    left, right = np.arange(n), np.arange(n, n + m)
    while True:
        low = np.where(near, right[None, :], n + m).min(axis=1, initial=n + m)
        new_left = np.minimum(left, low)
        low = np.where(near, new_left[:, None], n + m).min(axis=0, initial=n + m)
        new_right = np.minimum(right, low)
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def compare(
    space: Subspaces, block: int, node: np.ndarray, members: np.ndarray, points: np.ndarray, home: np.ndarray, part: np.ndarray
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, a, b) of one cell or of two parts of it.

    kind 0: node ``a`` has ``b`` further links; 1: a link of a spanning set; 2: a pair to verify.
    Two visitors of a cell meet elsewhere; two rows of the same part meet where that part is alone.
    """
    points = points.astype(np.float64)
    split = part.min() != part.max() if len(part) else False
    links, out = np.zeros(len(node), np.int64), []
    sure = max(space.distance - 2 * space.slack, 0.0) ** 2
    maybe = (space.distance + 2 * space.slack) ** 2
    for first in range(0, len(node), STRIP):
        rows = np.arange(first, min(first + STRIP, len(node)))
        columns = np.arange(first, len(node))
        allowed = (rows[:, None] < columns[None, :]) & (home[rows][:, None] | home[columns][None, :])
        if split:
            allowed &= part[rows][:, None] != part[columns][None, :]
        near = (space.block_distances(points[rows], points[columns], block) <= space.budgets[block]) & allowed
        # What is left is small unless the rows are near copies of each other.
        down, across = near.any(axis=1), near.any(axis=0)
        rows, columns, near = rows[down], columns[across], near[down][:, across]
        if not near.size:
            continue
        whole = np.zeros(near.shape)
        for other in range(len(space.cuts)):
            squared = space.block_distances(points[rows], points[columns], other)
            whole += squared
            if other < block:
                near &= squared > space.budgets[other]
        linked = near & (whole <= sure)
        links[rows] += linked @ members[columns]
        links[columns] += members[rows] @ linked
        a, b = np.nonzero(near & ~linked & (whole <= maybe))
        out.append((np.full(len(a), 2), node[rows[a]], node[columns[b]]))
        ids = np.concatenate([node[rows], node[columns]])
        roots = np.concatenate(_labels_of(linked))
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        out.append((np.full(len(moved), 1), ids[moved], ids[roots[moved]]))
    counted = np.flatnonzero(links)
    out.append((np.zeros(len(counted), np.int64), node[counted], links[counted]))
    return out


def _valid(vector: Column) -> Column:
    """Vectors with a direction: not NULL, no NULL or non-finite part, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_classes(keyed: DataFrame) -> DataFrame:
    """One row per distinct vector and label: node, embedding, members and first_id; written."""
    grouped = keyed.groupBy(*CLASS).agg(
        F.any_value("embedding").alias("embedding"),
        F.count(F.lit(1)).alias("members"),
        F.min("vec_id").alias("first_id"),
    )
    return written(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")


def cell_rows(classes: DataFrame, limit: float = LIMIT, blocks: int = BLOCKS) -> DataFrame:
    """Points in their cells: (label, dims, block, cell, home, node, members, point)."""
    small_batches(classes.sparkSession)
    sizes = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    axes = grid_axes(sizes["n"] or 0)
    schema = "label long, dims int, block int, cell long, home boolean, node long, members long, point binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            flat, offsets = batch.column("embedding").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            columns = {c: batch.column(c).to_numpy() for c in ("label", "node", "members")}
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d not in spaces:
                    spaces[d] = Subspaces(int(d), limit, blocks, axes)
                space = spaces[d]
                points = space.points(flat[offsets[rows][:, None] + np.arange(d)].astype(np.float64))
                sent = [p.tobytes() for p in points]
                for block in range(len(space.cuts)):
                    for at, cell, home in space.cells(points, block):
                        own = rows[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(columns["label"][own], pa.int64()), pa.array(dims[own], pa.int32()),
                                pa.array(np.full(len(at), block, np.int32)), pa.array(cell),
                                pa.array(np.full(len(at), home)), pa.array(columns["node"][own], pa.int64()),
                                pa.array(columns["members"][own], pa.int64()), pa.array([sent[i] for i in at], pa.binary()),
                            ],
                            names=["label", "dims", "block", "cell", "home", "node", "members", "point"],
                        )

    return classes.select("label", "dims", "embedding", "node", "members").mapInArrow(place, schema)


def findings(cells: DataFrame, limit: float = LIMIT, blocks: int = BLOCKS) -> DataFrame:
    """(kind, a, b) of all cells, as :func:`compare` tells them; written.

    Cells of more than ``CELL_ROWS`` rows are cut into parts by a hash of the node; a row goes to every pair
    of parts that has its own. The list of such cells is joined by its measured size.
    """
    place = ["label", "dims", "block", "cell"]
    hot = cells.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
    hot = written(hot.select(*place, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")), "hot-cells")
    parts = F.coalesce("parts", F.lit(1))
    dealt = (
        cells.join(hot, place, "left")
        .withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .drop("parts", "other")
    )

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, dims, block, *_ = (int(k) for k in key)
        space = Subspaces(dims, limit, blocks)
        points = np.frombuffer(b"".join(rows["point"]), np.int16).reshape(-1, dims)
        columns = (rows[c].to_numpy() for c in ("node", "members"))
        found = compare(space, block, *columns, points, rows["home"].to_numpy(), rows["part"].to_numpy())
        kind, a, b = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"kind": kind, "a": a, "b": b})

    judged = dealt.groupBy(*place, "low", "high").applyInPandas(judge, "kind long, a long, b long")
    return written(judged, "findings")


def verified(pairs: DataFrame, classes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Pairs (a, b) whose original vectors reach the limit, with the members of both."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("embedding").alias(f"v{c}"), F.col("members").alias(f"m{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(_cosine(F.col("va"), F.col("vb")) >= limit).select("a", "b", "ma", "mb")


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, blocks: int = BLOCKS) -> DataFrame:
    """``vectors`` with n_links, component_id and kept, linked where labels are equal and the cosine reaches ``limit``.

    Rows are nodes of their own: equal vectors, and rows that repeat an id, link with each other.
    Equal vectors are compared once. Rows with a NULL label, and vectors that are NULL, empty, zero or
    hold a NULL or non-finite part, have no links. Vectors of different length have no cosine.
    A NULL id links like any other; a component of NULL ids alone has a NULL id and a NULL ``kept``.
    An empty table stays empty. Columns named like the new ones are replaced, all others stay.
    """
    kept = vectors.drop("n_links", "component_id", "kept")
    name = {c: f"_c{i}" for i, c in enumerate(kept.columns)}
    plain = kept.toDF(*name.values())
    vector, label = F.col(name["embedding"]), F.col(name["label"])
    # Zero has one sign only, so that equal vectors have equal hashes; 128 bits tell vectors apart.
    clean = F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))
    usable = label.isNotNull() & _valid(vector)
    rows = plain.select(
        "*",
        F.when(usable, label.cast("long")).alias("label"),
        F.size(vector).alias("dims"),
        F.when(usable, F.xxhash64(F.lit(1), clean)).alias("k1"),
        F.when(usable, F.xxhash64(F.lit(2), clean)).alias("k2"),
    )
    keyed = rows.where("k1 is not null").select(
        *CLASS, F.col(name["vec_id"]).cast("long").alias("vec_id"), vector.alias("embedding")
    )
    classes = vector_classes(keyed)
    found = findings(cell_rows(classes, limit, blocks), limit, blocks)
    checked = written(verified(found.where("kind = 2").select("a", "b"), classes, limit), "verified")
    counts = (
        found.where("kind = 0")
        .select("a", "b")
        .unionByName(checked.select("a", F.col("mb").alias("b")))
        .unionByName(checked.select(F.col("b").alias("a"), F.col("ma").alias("b")))
        .groupBy(F.col("a").alias("node"))
        .agg(F.sum("b").alias("others"))
    )
    links = found.where("kind = 1").select("a", "b").unionByName(checked.select("a", "b"))
    labelled = (
        classes.drop("embedding")
        .join(component_labels(links).withColumnRenamed("label", "root"), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    firsts = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = labelled.join(firsts, "root").join(counts, "node", "left").select(
        *CLASS, "members", "component_id", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links")
    )
    lean = rows.withColumn("_first", F.col(name["vec_id"]).cast("long"))
    met = lookup_join(lean, written(per_class, "classes"), CLASS, ["_first"], "left", rows="members", rows_per_task=ROWS_PER_TASK)
    component = F.when(F.col("members").isNull(), F.col("_first")).otherwise(F.col("component_id"))
    return met.select(
        *[F.col(n).alias(c) for c, n in name.items()],
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (F.col("_first") == component).alias("kept"),
    )


# All pairs of a label, and components by following links from every vector.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached(vec_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT vec_id, min(other) AS other FROM reached GROUP BY vec_id
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l USING (vec_id) LEFT JOIN counts c USING (vec_id)
"""


@query("op13_embedding_dedup", SQL)
def op13_embedding_dedup(spark, folder):
    """Links, component and verdict of every vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")
