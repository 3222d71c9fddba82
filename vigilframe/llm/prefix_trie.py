"""Trie of the turn prefixes that conversations share.

Every turn is reduced to a digest where it is read, so no text is shuffled. The digest
of a prefix is the exclusive or of the hashes of its (place, turn) pairs, as in Zobrist
hashing, in 128 bits: such prefixes are built by a scan over ranges of rows, and a
conversation of any length is cut into as many ranges as it needs.

A count-min sketch of all prefix digests screens them. It never underestimates, so a
prefix estimated at one has one conversation, and so has all that follows it: those
tails become nodes where they are read. Only prefixes that may be shared, and the first
proven single behind them, are shuffled and grouped exactly. The sketch has two rows
of four cells per prefix, at most ``MAX_CELLS``, of two bits each once merged (16 MB at
most). Beyond that bound it proves fewer tails; results stay the same.

NULL roles and texts count as empty. Turns are ordered by ``turn``, NULL first, and tied
turns by their digest. Rows without a conv_id belong to no conversation. Repeated rows are
turns of their own. Other columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import query, small_batches, table, written
from vigilframe.plans.skew import PART, cut_ranges, lookup_join, scan_ranges

# Cells of one row of the sketch: four per prefix, between these bounds.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 25
# Cells travel in slices of this many; places inside a slice fit 16 bits.
SLICE = 1 << 16
# A key with more rows than this is split where rows meet their node.
ROWS_PER_TASK = 100_000
# Ids of one node are joined to texts of about this size before they are hashed in order.
PIECE_BYTES = 1 << 18
BORROWED_MOST = 9
BASE_STEP = 5
NODE = ["depth", "x1", "x2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, token, nbytes): digest of role and text, and UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps (role, text) pairs apart.
    joined = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(joined, 256)), 1, 16).alias("token"),
        F.octet_length(text).cast("long").alias("nbytes"),
    )


def _place_hash(seed: int, depth: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth.cast("int"), F.col("token"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"z1": _place_hash(11, F.col("depth")), "z2": _place_hash(23, F.col("depth"))})


def own_beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, n, m, h, head): every conversation as it is, with nothing borrowed."""
    head = F.array().cast("array<struct<depth:int,x1:long,x2:long,z1:long,z2:long,nbytes:long>>")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("conv_id", "n", F.lit(0).alias("m"), F.lit(0).alias("h"), head.alias("head"))


def borrowed_beginnings(turns: DataFrame) -> DataFrame:
    """As :func:`own_beginnings`, where conversation c starts with the first ``h`` turns of c - c % 5.

    ``head`` holds those ``m`` turns; ``m`` is less than ``h`` where the other one is shorter or absent.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "token")
    # Map tasks keep their own first turns only, so a long conversation is no hot key here.
    firsts = (
        turns.where(F.col("conv_id") % BASE_STEP == 0)
        .withColumn("depth", F.row_number().over(order))
        .where(F.col("depth") < BORROWED_MOST)
    )
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    bases = (
        _hashed(firsts)
        .withColumns({"x1": F.bit_xor("z1").over(upto), "x2": F.bit_xor("z2").over(upto)})
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "x1", "x2", "z1", "z2", "nbytes"))).alias("first"))
    )
    c = F.col("conv_id")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    asked = counts.withColumn("base", c - c % BASE_STEP).withColumn(
        "h", (F.crc32(c.cast("string").cast("binary")) % BORROWED_MOST).cast("int")
    )
    empty = F.array().cast(bases.schema["first"].dataType)
    head = F.slice(F.coalesce("first", empty), F.lit(1), F.col("h"))
    return asked.join(bases, "base", "left").select("conv_id", "n", F.size(head).alias("m"), "h", head.alias("head"))


def prefix_rows(turns: DataFrame, beginnings: DataFrame) -> DataFrame:
    """One row per conversation and prefix: (conv_id, depth, x1, x2, p1, p2, nbytes, last), written.

    (x1, x2) is the digest of the prefix, (p1, p2) that of the prefix before it; the root has depth 0.
    """
    beginnings = written(beginnings, "beginnings")
    lean = beginnings.select("conv_id", "n", "m", "h", F.try_element_at("head", F.lit(-1)).alias("end")).select(
        "conv_id", "n", "m", "h", F.coalesce("end.x1", F.lit(0)).alias("b1"), F.coalesce("end.x2", F.lit(0)).alias("b2")
    )
    known = lookup_join(turns, lean, ["conv_id"], ["turn", "token"], "inner", rows="n", rows_per_task=ROWS_PER_TASK)
    ranged = cut_ranges(known, ["conv_id"], ["turn", "token"])
    placed = scan_ranges(ranged, ["conv_id"], ["turn", "token"], {"place": ("count", "conv_id")})
    own = _hashed(
        placed.where("place > h").withColumn("depth", (F.col("place") - F.col("h") + F.col("m")).cast("int"))
    )
    own = scan_ranges(own, ["conv_id"], ["turn", "token"], {"y1": ("xor", "z1"), "y2": ("xor", "z2")}).select(
        "conv_id", "depth", F.col("y1").bitwiseXOR(F.col("b1")).alias("x1"), F.col("y2").bitwiseXOR(F.col("b2")).alias("x2"),
        "z1", "z2", "nbytes", (F.col("place") == F.col("n")).alias("last"), PART,
    )
    # Borrowed turns and the root come first in the first range of their conversation.
    first_part = ranged.groupBy("conv_id").agg(F.min(PART).alias(PART))
    root = F.array(F.struct(*[F.lit(0).cast(kind).alias(name) for name, kind in
                              (("depth", "int"), ("x1", "long"), ("x2", "long"), ("z1", "long"), ("z2", "long"), ("nbytes", "long"))]))
    ends = (F.col("n") <= F.col("h")) & (F.col("depth") == F.col("m"))
    heads = (
        beginnings.select("conv_id", "n", "m", "h", F.inline(F.concat(root, "head")))
        .join(first_part, "conv_id")
        .select("conv_id", "depth", "x1", "x2", "z1", "z2", "nbytes", ends.alias("last"), PART)
    )
    rows = own.unionByName(heads)
    before = {f"p{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)}
    return written(rows.withColumns(before).drop("z1", "z2"), "prefixes")


# --- count-min sketch -------------------------------------------------------------------


class Sketch:
    """Two rows of saturating counters: 0, 1, or 2 for more."""

    def __init__(self, cells: int, packed: bytes):
        self.cells, self.packed = cells, np.frombuffer(packed, np.uint8)

    def may_be_shared(self, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        """False where a digest is proven to have one conversation."""
        shared = np.ones(len(x1), bool)
        for row, x in enumerate((x1, x2)):
            at = _cells(x, self.cells) + row * self.cells
            shared &= (self.packed[at >> 2] >> ((at & 3) * 2).astype(np.uint8) & 3) > 1
        return shared


def _cells(x: np.ndarray, cells: int) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def _cell_count(prefixes: int) -> int:
    return min(MAX_CELLS, max(MIN_CELLS, 1 << (4 * prefixes - 1).bit_length()))


def build_sketch(rows: DataFrame) -> Sketch:
    """Sketch of the digests (x1, x2) of all rows.

    Tasks send the cells they saw once and more than once, slice by slice, two bytes
    each; slices are added up in parallel and reach the driver packed, ``2 * cells / 4`` bytes in all.
    """
    cells = _cell_count(rows.count())
    width = min(SLICE, 2 * cells)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * cells, np.uint8)
        for batch in batches:
            for row, name in enumerate(("x1", "x2")):
                at, n = np.unique(_cells(batch.column(name).to_numpy(), cells) + row * cells, return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)
        at = np.flatnonzero(counts)
        cut = np.flatnonzero(np.diff(at // width)) + 1
        for piece in np.split(at, cut) if len(at) else []:
            n = counts[piece]
            inside = [(piece[n == k] % width).astype(np.uint16).tobytes() for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece[0] // width]), pa.array([inside[0]]), pa.array([inside[1]])], names=["slice", "once", "more"]
            )

    def added(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(width, np.uint16)
        for once, more in zip(group["once"], group["more"]):
            counts[np.frombuffer(once, np.uint16)] += 1
            counts[np.frombuffer(more, np.uint16)] = 2
            np.minimum(counts, 2, out=counts)
        four = counts.astype(np.uint8).reshape(-1, 4)
        packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "packed": [packed.tobytes()]})

    merged = (
        rows.select("x1", "x2")
        .mapInArrow(seen, "slice long, once binary, more binary")
        .groupBy("slice")
        .applyInPandas(added, "slice long, packed binary")
    )
    packed = bytearray(2 * cells // 4)
    for r in merged.collect():  # at most 2 * MAX_CELLS / SLICE rows of 16 KB
        first = r["slice"] * width // 4
        packed[first : first + width // 4] = r["packed"]
    return Sketch(cells, bytes(packed))


def screened(rows: DataFrame, sketch: Sketch) -> DataFrame:
    """``rows`` with ``kind``: 0 behind a proven single, 1 a proven single, 2 perhaps shared.

    The root is always 2: its members are counted, not estimated.
    """
    held = rows.sparkSession.sparkContext.broadcast((sketch.cells, sketch.packed.tobytes()))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tester = Sketch(*held.value)
        for batch in batches:
            x1, x2, p1, p2 = (batch.column(c).to_numpy() for c in ("x1", "x2", "p1", "p2"))
            depth = batch.column("depth").to_numpy()
            own = tester.may_be_shared(x1, x2) | (depth == 0)
            parent = tester.may_be_shared(p1, p2) | (depth <= 1)
            kind = np.where(parent, np.where(own, 2, 1), 0).astype(np.int32)
            yield batch.append_column("kind", pa.array(kind))

    return rows.mapInArrow(screen, rows.select("*", F.lit(0).alias("kind")).schema)


# --- nodes ----------------------------------------------------------------------------


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def list_digests(members: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): SHA-256 of the comma-joined ascending conv_ids per node.

    Ids are sorted by range, so one node spreads over many tasks, which join them to
    texts; the texts of a node are then hashed in order, as a stream. Only that last step is
    bound to one task per node, since SHA-256 is sequential; it reads a row per quarter megabyte.
    """
    schema = "depth int, x1 long, x2 long, first long, ids binary"

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids, size, out = None, [], 0, []

        def close():
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids)).encode()))

        for batch in batches:
            for *key, conv in batch.itertuples(index=False):
                if key != node or size > PIECE_BYTES:
                    close()
                    node, ids, size = key, [], 0
                ids.append(conv)
                size += 20
            if out:
                yield pd.DataFrame(out, columns=["depth", "x1", "x2", "first", "ids"])
                out.clear()
        close()
        yield pd.DataFrame(out, columns=["depth", "x1", "x2", "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for batch in batches:
            done = []
            for *key, _, ids in batch.itertuples(index=False):
                if key != node:
                    if running:
                        done.append((*node, running.hexdigest()))
                    node, running = key, hashlib.sha256(ids)
                else:
                    running.update(b"," + ids)
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if running:
            yield pd.DataFrame([(*node, running.hexdigest())], columns=[*NODE, "ends_sha256"])

    pieces = (
        members.select(*NODE, "conv_id")
        .repartitionByRange("x1", "x2", "depth", "conv_id")
        .sortWithinPartitions("x1", "x2", "depth", "conv_id")
        .mapInPandas(join, schema)
    )
    streams = pieces.repartition("x1", "x2", "depth").sortWithinPartitions("x1", "x2", "depth", "first")
    return streams.mapInPandas(digest, "depth int, x1 long, x2 long, ends_sha256 string")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the trie over ``prefix_rows``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, (n_convs - 1) times the bytes of the last turn) and ends_sha256 (of the
    ids of members that end here). Sums over a subtree need no walk down the trie: every
    node below belongs to its smallest member, whose own rows lead back to all nodes above.
    """
    small_batches(rows.sparkSession)
    marked = screened(rows, build_sketch(rows))
    moved = written(marked.where("kind > 0").drop("p1", "p2"), "perhaps-shared")
    groups = written(
        moved.where("kind = 2")
        .groupBy(*NODE)
        .agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"))
        .where("n_convs > 1"),
        "shared-nodes",
    )
    met = lookup_join(moved.where("kind = 2"), groups, NODE, ["conv_id"], "left", rows="n_convs", rows_per_task=ROWS_PER_TASK)
    known = met.unionByName(moved.where("kind = 1"), allowMissingColumns=True).withColumns(
        {
            "rep": F.coalesce("rep", "conv_id"),
            "n_convs": F.coalesce("n_convs", F.lit(1)),
            "n_ends": F.coalesce("n_ends", F.col("last").cast("long")),
        }
    )
    mine = F.col("rep") == F.col("conv_id")
    # A proven single ends in a leaf of its own, whether or not the rest of it is here.
    known = known.withColumns(
        {
            "saving": F.when(mine, (F.col("n_convs") - 1) * F.col("nbytes")).otherwise(0),
            "leaf": ((F.col("n_convs") == 1) | (F.col("last") & mine & (F.col("n_convs") == F.col("n_ends")))).cast("long"),
            "above": F.struct("depth", "rep"),
            "mine": mine.cast("long"),
            "_tie": F.lit(0),
        }
    )
    known = written(known, "known-prefixes")
    up = scan_ranges(
        known, ["conv_id"], ["depth"],
        {"saved": ("sum", "saving"), "leaves": ("max", "leaf"), "child": ("lag", "mine")},
        backward=True,
    )
    both = scan_ranges(up, ["conv_id"], ["depth"], {"parent": ("lag", "above")})
    parent = F.when(F.col("depth") > 0, F.when(F.col("parent.depth") == F.col("depth") - 1, F.col("parent.rep")).otherwise(F.col("conv_id")))
    both = both.withColumn("parent", parent)
    single = F.col("n_convs") == 1
    ends_own = F.when(F.col("last"), _sha(F.col("conv_id").cast("string"))).otherwise(_sha(F.lit("")))

    def single_nodes(source: DataFrame, above: str) -> DataFrame:
        return source.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.col(above).alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            ends_own.alias("ends_sha256"),
        )

    shared = (
        both.where(~single)
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.coalesce("child", F.lit(0))).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
            F.sum(F.col("last").cast("long")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end"),
        )
    )
    lists = list_digests(known.where("last and n_convs > 1 and n_ends > 1"))
    text = F.when(F.col("n_ends") == 0, F.lit("")).otherwise(F.col("end").cast("string"))
    shared = shared.join(lists, NODE, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", _sha(text)).alias("ends_sha256"),
    )
    tails = single_nodes(marked.where("kind = 0"), "conv_id")
    return shared.unionByName(single_nodes(both.where(single), "parent")).unionByName(tails)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations as they are."""
    turns = written(turn_digests(conversations), "turns")
    return trie_nodes(prefix_rows(turns, own_beginnings(turns)))


# The same by whole prefixes: each is named by the digests of its turns, one after the other.
# The CRC-32 of the id is folded bit by bit, since DuckDB has no function for it.
SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS place, sha, nbytes
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS nbytes,
               sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sha
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, [ord(c)::BIGINT for c in string_split(conv_id::VARCHAR, '')]),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), borrowed AS (
  SELECT c.conv_id, t.place AS depth, t.sha, t.nbytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
), heads AS (
  SELECT c.conv_id, c.h, count(b.depth) AS m FROM convs c LEFT JOIN borrowed b USING (conv_id) GROUP BY ALL
), whole AS (
  SELECT conv_id, depth, sha, nbytes FROM borrowed
  UNION ALL SELECT t.conv_id, t.place - h.h + h.m, t.sha, t.nbytes FROM turns t JOIN heads h USING (conv_id) WHERE t.place > h.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), paths AS (
  SELECT conv_id, depth, nbytes, string_agg(sha, '') OVER upto AS path,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM whole WINDOW upto AS (PARTITION BY conv_id ORDER BY depth)
), stepped AS (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM paths
), nodes AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(nbytes) AS nbytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM stepped GROUP BY depth, path
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.above = n.path AND k.depth = n.depth + 1) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.path = n.above AND p.depth = n.depth - 1
), sums AS (
  SELECT a.depth, a.path, sum((k.n_convs - 1) * k.nbytes)::BIGINT AS saved_tokens, count_if(k.n_children = 0)::BIGINT AS n_leaves
  FROM counted k JOIN stepped a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums USING (depth, path)
"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark, folder):
    """All nodes of the trie of rebuilt conversations."""
    turns = written(turn_digests(table(spark, folder, "conversations")), "turns")
    return trie_nodes(prefix_rows(turns, borrowed_beginnings(turns)))
