"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import written


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest; rounds go on until nothing changes, a number that grows with the logarithm
    of the longest chain. Links are written to the shared folder after each round, so a
    lost executor costs no recomputation; the driver sees two sums per round.
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # Every link now points to a smaller node; the small star links them all to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _digest(edges)
        if state == before:
            break
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _digest(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))
    ).first()
    return tuple(row)
