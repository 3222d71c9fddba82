"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt to shards by some of their bits: cut into ``parts``
runs of bits, two fingerprints within the radius agree on ``parts - radius`` runs at
least, so every close pair meets in one shard or more. Each shard is one BK-tree:
children are keyed by the Hamming distance to their parent, and a search follows
only edges within the radius around its own distance. A shard's tree stays with the
task that owns the shard: fingerprints grow with the corpus, so trees of all of them
have no bound that would allow a broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import keeps_columns, query, small_batches, table, written
from vigilframe.llm.components import component_labels

RADIUS = 3
SHINGLE = 3
SEED = 42
# Shards of about this size are aimed at when the number of bit runs is chosen.
SHARD_ROWS = 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is set if it is set in over half the hashes of the shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    hash64 = xxhash.xxh64_intdigest
    hashes = [hash64(joined[a:b], seed) for a, b in zip(starts, stops)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_fp``, the fingerprint as a signed long; NULL and empty texts give 0."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t, shingle, seed) for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return docs.withColumn("_fp", fp("text"))


class BKTree:
    """Nodes in arrays of Python ints; a node's children by their distance to it."""

    def __init__(self, root: int):
        self.keys, self.children = [root], [{}]

    def add_and_find(self, key: int, radius: int) -> list[int]:
        """Insert ``key``, not yet held; nodes within ``radius`` that were there before."""
        keys, children, found = self.keys, self.children, []
        stack, at = [0], 0
        while stack:
            node = stack.pop()
            d = (keys[node] ^ key).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        while True:
            d = (keys[at] ^ key).bit_count()
            child = children[at].get(d)
            if child is None:
                children[at][d] = len(keys)
                break
            at = child
        keys.append(key)
        children.append({})
        return found


def _shard_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected inside one shard: at most one per fingerprint and group met."""
    keys = [int(x) for x in fps.view(np.uint64)]
    tree, parent, links = BKTree(keys[0]), list(range(len(keys))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(1, len(keys)):
        for j in tree.add_and_find(keys[i], radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def shard_keys(count: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the shards: each keeps ``parts - radius`` of ``parts`` runs of bits."""
    parts = radius + 1
    while parts < radius + 4 and count > SHARD_ROWS << (64 * (parts - radius) // parts):
        parts += 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(runs, parts - radius)]


def close_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) over distinct ``fp``: enough pairs within the radius to connect all that are linked.

    Within a shard, pairs already connected are left out: thousands of near copies give
    as many links as members, not all pairs.
    """
    small_batches(fps.sparkSession)
    masks = shard_keys(fps.count(), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    shards = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "bits"),
    )

    def link(batches):
        # Rows come sorted by shard; a shard may continue in the next batch.
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if batch.empty:
                continue
            mask, bits = batch["mask"].to_numpy(), batch["bits"].to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            rest = batch.iloc[last:]
            yield linked(batch["fp"].to_numpy()[:last], cut[:-1] if len(cut) else cut)
        if rest is not None and len(rest):
            yield linked(rest["fp"].to_numpy(), np.zeros(0, np.int64))

    def linked(fp, cut):
        out = []
        for group in np.split(fp, cut) if len(fp) else []:
            if len(group) > 1:
                group = np.ascontiguousarray(group)
                out += [(group[i], group[j]) for i, j in _shard_links(group, radius)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    sorted_shards = shards.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return sorted_shards.mapInPandas(link, "a long, b long").distinct()


def groups(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(_fp, root, component_id) of every distinct ``_fp`` of rows (doc_id, _fp).

    ``root`` names the group; ``component_id`` is its smallest doc_id.
    """
    nodes = fingerprints.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first_id"))
    nodes = written(nodes, "nodes")
    labels = component_labels(close_links(nodes.select("fp"), radius))
    grouped = nodes.join(labels, nodes["fp"] == labels["node"], "left").withColumn(
        "root", F.coalesce("label", "fp")
    )
    firsts = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return grouped.select("fp", "root").join(firsts, "root").select(F.col("fp").alias("_fp"), "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``_fp`` and ``component_id``, the smallest doc_id that links reach.

    Equal fingerprints are one node, so groups of copies cost one row. NULL ids take
    part in links; a component with NULL ids alone has a NULL id. Repeated rows and
    ids keep their own output rows. Extra columns stay unless named like the new ones.
    """
    rows = written(with_fingerprint(docs.drop("_fp", "component_id")), "fingerprints")
    return rows.join(groups(rows, radius).drop("root"), "_fp")


@keeps_columns("doc_id", "text")
def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    Of rows with equal ids, the one read first stays; a NULL id stays only where a
    group has no other. Only ids and fingerprints move to find the rows that stay.
    """
    own = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = written(with_fingerprint(own), "fingerprints")
    # NULLs come last: the flag orders them behind every id.
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    best = (
        rows.select("_fp", first.alias("first"))
        .join(groups(rows.select("doc_id", "_fp"), radius), "_fp")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
    )
    stay = best.select(F.col("first._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi")


@query("op6_simhash")
def op6_simhash(spark, folder):
    """Fingerprint and component of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
