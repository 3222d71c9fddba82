"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and rearranged.

A text is cut into fixed blocks of UTF-8 bytes. Two Fenwick trees hold how many units and
how many code points start in each block. The k-th unit is found by binary-lifting
descent: steps of falling powers of two skip whole groups of blocks while fewer than
k units lie in them, adding up the code points passed; the boundary is then located inside the
one block reached. So a cut costs the logarithm of the number of blocks and one block,
whatever the length of the text and the kind of unit.

Cuts and forms come from a hash of the id, so a task that runs again gives the same rows.
NULL texts count as empty, NULL ids as the empty text inside the hash; repeated rows and ids
keep their own rows. Texts of any length stay whole: a task holds one batch of texts.
Nothing is shuffled. Columns named like the new ones are replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from vigilframe.llm.common import query, small_batches, table

BLOCK = 4096
# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
# Of 100 texts, this many are rearranged, and of 100 rearranged ones so many start with the suffix.
CHANGED, SUFFIX_FIRST = 90, 20
SALT = "1:"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
ADDED_FIELDS = [
    StructField("_n", LongType()), StructField("_form", StringType()), StructField("_prefix_chars", LongType()),
    StructField("_middle_chars", LongType()), StructField("_output", BinaryType()),
]


def code_point_starts(data: np.ndarray) -> np.ndarray:
    """True at every byte that starts a code point."""
    return (data & 0xC0) != 0x80


def word_starts(data: np.ndarray) -> np.ndarray:
    """True where a word starts; white space belongs to the word before it.

    White space before the first word is a unit of its own.
    """
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = ~space
    first[1:] &= space[:-1]
    if len(first):
        first[0] = True
    return first


def line_starts(data: np.ndarray) -> np.ndarray:
    """True where a line starts; the newline belongs to the line it ends."""
    first = np.zeros(len(data), bool)
    first[:1] = True
    first[1:] = data[:-1] == 0x0A
    return first


UNITS = {"code_point": code_point_starts, "word": word_starts, "line": line_starts}


class UnitTree:
    """Units and code points that start in each block of a text, as Fenwick trees."""

    def __init__(self, text: bytes, unit: str = "code_point", block: int = BLOCK):
        data = np.frombuffer(text, np.uint8)
        self.block = block
        self.starts = UNITS[unit](data)
        self.points = self.starts if unit == "code_point" else code_point_starts(data)
        at = np.arange(0, len(data), block)
        self.units_tree, self.n = self._tree(self.starts, at)
        self.points_tree, self.n_points = self._tree(self.points, at)

    @staticmethod
    def _tree(starts: np.ndarray, at: np.ndarray) -> tuple[list[int], int]:
        """Node i holds the blocks i - lowbit(i) to i - 1: a difference of two running sums."""
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(starts, at, dtype=np.int64))]) if len(at) else np.zeros(1, np.int64)
        node = np.arange(len(sums))
        return (sums - sums[node - (node & -node)]).tolist(), int(sums[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """Byte offset behind the first ``k`` units, and the number of code points before it."""
        if k >= self.n:
            return len(self.starts), self.n_points
        units, points = self.units_tree, self.points_tree
        at = passed = 0
        step = 1 << (len(units) - 1).bit_length()
        while step:
            there = at + step
            # All blocks up to ``there`` hold at most k units: unit number k starts behind them.
            if there < len(units) and units[there] <= k:
                at, k, passed = there, k - units[there], passed + points[there]
            step >>= 1
        first = at * self.block
        inside = int(np.flatnonzero(self.starts[first : first + self.block])[k])
        return first + inside, passed + int(np.count_nonzero(self.points[first : first + inside]))


def _rearranged(
    text: bytes, h1: int, h2: int, h3: int, h4: int, unit: str
) -> tuple[int, str, int | None, int | None, bytes]:
    tree = UnitTree(text, unit)
    n = tree.n
    if not text or h3 % 100 >= CHANGED or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_points), (b, b_points) = tree.cut(low), tree.cut(high)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        form, out = "spm", (SUFFIX, tail, PREFIX, head, MIDDLE, middle)
    else:
        form, out = "psm", (PREFIX, head, SUFFIX, tail, MIDDLE, middle)
    return n, form, a_points, b_points - a_points, b"".join(out)


def _hash_part(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "code_point") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output, the rearranged text.

    ``n`` counts units: ``code_point``, ``word`` or ``line``. Lengths are in code points
    whatever the unit, NULL where the form is ``plain``.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(*ADDED)
    places = list(range(len(kept.columns)))
    # Columns travel under numbers, so none clashes with a name used here.
    plain = kept.toDF(*[f"_c{i}" for i in places])
    name = {c: f"_c{i}" for i, c in enumerate(kept.columns)}
    digest = F.sha2(
        F.concat(F.lit(SALT), F.coalesce(F.col(name["doc_id"]).cast("string"), F.lit(""))).cast("binary"), 256
    )
    rows = plain.withColumn("_text", F.coalesce(F.col(name["text"]), F.lit("")).cast("binary")).withColumns(
        {f"_h{i}": _hash_part(digest, i) for i in range(4)}
    )
    # The text comes back as part of the output; restored() gives it again.
    carried = rows.withColumn("_null", F.col(name["text"]).isNull()).drop(name["text"])
    back = [c for c in carried.columns if c != "_text" and not c.startswith("_h")]
    schema = StructType([carried.schema[c] for c in back] + ADDED_FIELDS)

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = zip(*[batch.column(f"_h{i}").to_pylist() for i in range(4)])
            made = [_rearranged(t, *h, unit) for t, h in zip(batch.column("_text").to_pylist(), hashes)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in back], *new], names=[f.name for f in schema.fields]
            )

    made = carried.mapInArrow(rearrange, schema).withColumn("_output", F.col("_output").cast("string"))
    text = F.when(~F.col("_null"), restored(F.col("_output"), F.col("_form")))
    return made.select(
        *[(text if c == "text" else F.col(name[c])).alias(c) for c in kept.columns],
        F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"),
        F.col("_middle_chars").alias("middle_chars"), F.col("_output").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the rearranged one and its form; texts that hold a mark are plain."""
    parts = F.split(output, "|".join(m.decode() for m in MARKS))
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(2), part(4), part(3)))
        .when(form == "spm", F.concat(part(3), part(4), part(2)))
        .otherwise(output)
    )


SQL = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), cuts AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM base
), parts AS (
  SELECT doc_id, n, form, t, least(c1, c2) AS a, greatest(c1, c2) - least(c1, c2) AS m,
         substr(t, 1, least(c1, c2)) AS head,
         substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS middle,
         substr(t, greatest(c1, c2) + 1) AS tail
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op12_fill_middle", SQL)
def op12_fill_middle(spark, folder):
    """Cuts, form and digests of the rearranged and of the rebuilt text of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
