"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so the largest cosine is the smallest Euclidean
distance. Each table hashes a vector by several projections cut into slots of one
width; a query visits its own slot and perturbed ones, in the order of estimated
success: the sum of squared distances to the slot borders crossed. Candidates of all
tables are merged, and ranked by the exact cosine of the original vectors.

Vectors of each number of dimensions are hashed and fitted apart. Queries that meet
fewer vectors than asked for, all queries of counts with few rows, and those of counts
for which no width reaches the recall asked for are compared with every vector.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import query, small_batches, table, written
from vigilframe.llm.words import mix

TABLES = 8
PROBES = 24
NEIGHBOURS = 5
QUERY_STEP = 50
# The slot width is fitted on at most this many vectors and probing is judged on them.
SAMPLE_ROWS = 4096
TARGET_RECALL = 0.95
# One task holds about this many vectors; larger slots are cut, each cut seeing all its queries.
GROUP_ROWS = 8192
# Counts of dimensions with so few vectors are searched exactly.
EXACT_ROWS = 256
SEED = 5


class Hashing:
    """Projections and slot width of all tables."""

    def __init__(self, dims: int, projections: int, width: float, tables: int = TABLES, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.tables, self.projections, self.width = tables, projections, width
        self.lines = random.normal(size=(dims, tables * projections))
        self.shift = random.uniform(0, 1, tables * projections)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Real-valued slot numbers, shaped (vector, table, projection)."""
        return (vectors @ self.lines / self.width + self.shift).reshape(-1, self.tables, self.projections)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """One 64-bit key per row of slot numbers (..., projection); tables are told apart by the caller."""
        key = np.zeros(slots.shape[:-1], np.uint64)
        for j in range(slots.shape[-1]):
            key = mix(key ^ slots[..., j].astype(np.int64).view(np.uint64)) + np.uint64(j)
        return key

    def probes(self, places: np.ndarray, count: int) -> np.ndarray:
        """Slot numbers to visit in one table, likeliest first: (probe, projection)."""
        base = np.floor(places)
        inside = places - base
        # Crossing the lower border costs the distance to it, the upper one likewise.
        moves = sorted(
            [(float(x) ** 2, j, -1) for j, x in enumerate(inside)]
            + [(float(1 - x) ** 2, j, 1) for j, x in enumerate(inside)]
        )
        out, heap = [base], [(moves[0][0], (0,))]
        while heap and len(out) < count:
            cost, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < len(moves):
                step = moves[last + 1][0]
                heapq.heappush(heap, (cost - moves[last][0] + step, (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
            if len({moves[m][1] for m in chosen}) == len(chosen):
                slot = base.copy()
                for m in chosen:
                    slot[moves[m][1]] += moves[m][2]
                out.append(slot)
        return np.array(out)


def fit(sample: np.ndarray, rows: int, target: float = TARGET_RECALL) -> Hashing | None:
    """Widest selective hashing: the number of projections grows with the logarithm of the rows.

    The slot width is the smallest of a fixed ladder that finds the nearest
    neighbours of sampled vectors with the recall asked for; None if none does.
    """
    projections = max(4, min(24, round(math.log2(max(rows, 2)) / 2)))
    dims = sample.shape[1] if len(sample) else 1
    if len(sample) < 2:
        return Hashing(dims, projections, 1.0)
    asked = sample[: min(128, len(sample))]
    cosine = asked @ sample.T
    np.fill_diagonal(cosine, -2.0)  # a vector is no neighbour of its own
    least = np.sort(cosine, axis=1)[:, -min(NEIGHBOURS, len(sample) - 1)]
    close = [np.flatnonzero(row >= x - 1e-12) for row, x in zip(cosine, least)]
    for width in (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0, 4.0):
        hashing = Hashing(dims, projections, width)
        places = hashing.places(sample)
        keys = hashing.keys(np.floor(places))
        found = total = 0
        for i, wanted in enumerate(close):
            hit = np.zeros(len(wanted), bool)
            for t in range(hashing.tables):
                visited = hashing.keys(hashing.probes(places[i, t], PROBES))
                hit |= np.isin(keys[wanted, t], visited)
            found, total = found + hit.sum(), total + len(wanted)
        if found >= target * total:
            return hashing
    return None


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.float64).reshape(len(values), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest part first, so that nothing overflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors in double precision without NULL, zero, NULL-holding or non-finite ones."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("v is not null and vec_id is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0))


def _hashed(rows: DataFrame, hashing: Hashing, probes: int) -> DataFrame:
    """``rows`` once per table and slot visited: table_no, key, and all columns. ``probes`` 1: the own slot."""
    shared = rows.sparkSession.sparkContext.broadcast(hashing)
    dims = hashing.lines.shape[0]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def slots(batches):
        h = shared.value
        for batch in batches:
            if batch.empty:
                continue
            sizes = batch["v"].map(len).to_numpy()
            padded = np.zeros((len(batch), dims))
            for size in np.unique(sizes):
                own = sizes == size
                padded[own, :size] = _unit(_matrix(batch["v"][own]))
            places = h.places(padded)
            for t in range(h.tables):
                if probes == 1:
                    row, keys = np.arange(len(batch)), h.keys(np.floor(places[:, t]))
                else:
                    visited = [h.keys(h.probes(p, probes)) for p in places[:, t]]
                    row, keys = np.repeat(np.arange(len(batch)), [len(x) for x in visited]), np.concatenate(visited)
                # Vectors of another number of dimensions never meet.
                keys = mix(keys ^ sizes[row].astype(np.uint64)).view(np.int64)
                yield pd.concat([pd.DataFrame({"table_no": t, "key": keys}), batch.iloc[row].reset_index(drop=True)], axis=1)

    return rows.mapInPandas(slots, f"table_no int, key long, {fields}")


def nearest(vectors: DataFrame, step: int = QUERY_STEP, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row.

    Queries are the rows whose id is divisible by ``step``. Rows with the query's own id
    are no candidates; rows that repeat id and vector count once. Of equal vectors only
    the ``k`` + 1 smallest ids can be among the nearest, so that many are kept and a
    vector that fills a third of the table is one candidate. NULL ids take no part.
    Vectors are compared with those of as many dimensions only.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors).distinct()
    same = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1)
    stock = firsts.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    stock = written(stock, "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(step)) == 0).select(F.col("vec_id").alias("query_id"), "v")

    # One row per number of dimensions.
    sizes = {r["dims"]: r["n"] for r in stock.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    met, exact = [], []
    for dims, n in sorted(sizes.items()):
        own = stock.where(F.size("v") == dims)
        hashing = None
        if n > EXACT_ROWS:
            sample = own.orderBy(F.xxhash64(F.lit(SEED), "v")).limit(SAMPLE_ROWS)
            hashing = fit(_unit(_matrix(sample.select("v").toPandas()["v"])), n)
        if hashing is None:
            exact.append(dims)
        else:
            met.append(_met(own, asked.where(F.size("v") == dims), hashing, n, k))
    pairs = None
    if met:
        found = reduce(DataFrame.unionByName, met).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        pairs = written(found, "met")
        enough = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= k)
        short = asked.join(enough, "query_id", "left_anti")
        rest = asked.where(F.size("v").isin(exact)).unionByName(short.where(~F.size("v").isin(exact)))
    else:
        rest = asked
    searched = _searched(stock, rest, k)
    merged = searched if pairs is None else searched.unionByName(pairs)
    merged = merged.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _best(queries: pd.DataFrame, ids: list, a: np.ndarray, b: np.ndarray, k: int) -> list[tuple]:
    """(query, vector, score) of the best of ``b`` for each query, ties included."""
    out = []
    score = _unit(a) @ _unit(b).T
    for query_id, row in zip(queries, score):
        # One more than asked for, as the query itself may be among them; ties stay in.
        least = -np.inf if len(row) <= k + 1 else np.partition(row, -k - 1)[-k - 1]
        for j in np.flatnonzero(row >= least - 1e-12):
            out += [(query_id, i, row[j]) for i in ids[j] if i != query_id]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"}
    )


def _searched(stock: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: exact search of every row of ``stock``, for queries in blocks of about ``GROUP_ROWS``.

    Queries travel to the rows, block by block; only a block's best of each batch move on.
    """
    spark = stock.sparkSession
    asked = written(asked, "asked")
    blocks = -(-asked.count() // GROUP_ROWS)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)) == block).toPandas()
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), rows["v"].tolist()))

        def compare(batches, shared=shared):
            query_ids, vectors = shared.value
            sizes = np.array([len(v) for v in vectors], int)
            own = {d: (query_ids[sizes == d], np.array([v for v in vectors if len(v) == d], np.float64)) for d in set(sizes.tolist())}
            for batch in batches:
                dims = batch["v"].map(len)
                for d, part in batch.groupby(dims):
                    if d in own:
                        yield _frame(_best(own[d][0], part["ids"].tolist(), own[d][1], _matrix(part["v"]), k))

        found = found.unionByName(stock.mapInPandas(compare, "query_id long, vec_id long, score double"))
    return found


def _met(stock: DataFrame, asked: DataFrame, hashing: Hashing, n: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best vectors of each slot that a query visits."""
    slots = _hashed(stock.select("v"), hashing, 1).groupBy("table_no", "key").agg(F.count(F.lit(1)).alias("c"))
    cuts = slots.where(F.col("c") > GROUP_ROWS).select(
        "table_no", "key", F.ceil(F.col("c") / GROUP_ROWS).cast("int").alias("cuts")
    )
    at = ["table_no", "key"]
    groups = max(1, -(-n * hashing.tables // GROUP_ROWS))
    group = F.pmod(F.xxhash64("table_no", "key", "cut"), F.lit(groups)).cast("int")
    one = F.coalesce("cuts", F.lit(1))
    left = (
        _hashed(stock, hashing, 1)
        .join(cuts, at, "left")
        .withColumn("cut", F.pmod(F.xxhash64("ids"), one).cast("int"))
        .withColumn("g", group)
        .drop("cuts")
    )
    right = (
        _hashed(asked, hashing, PROBES)
        .join(cuts, at, "left")
        .withColumn("cut", F.explode(F.sequence(F.lit(0), one - 1)))
        .withColumn("g", group)
        .drop("cuts")
    )

    def rank(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        places = data.groupby(["table_no", "key", "cut"]).indices
        for slot, asking in queries.groupby(["table_no", "key", "cut"]).indices.items():
            held = places.get(slot)
            if held is None:
                continue
            ids = data["ids"].iloc[held].tolist()
            a, b = _matrix(queries["v"].iloc[asking]), _matrix(data["v"].iloc[held])
            out += _best(queries["query_id"].iloc[asking], ids, a, b, k)
        return _frame(out)

    return left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(rank, "query_id long, vec_id long, score double")


@query("op9_nearest")
def op9_nearest(spark, folder):
    """Five nearest of every fiftieth vector."""
    return nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"))
