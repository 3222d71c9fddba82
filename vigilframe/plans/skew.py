"""Building blocks that keep one very large key from landing in one task.

A monitored key (tenant, metric, user, column) may hold a third of all rows.
Plain ``Window.partitionBy(key)`` or a join on that key would send those rows
to a single task. The helpers below cut such a key into time buckets, blocks
or salts, and stitch the pieces with tables that hold one row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.session import written

# A key with more rows than this is split.
ROWS_PER_TASK = 2_000_000


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, where NULL equals NULL; ``how`` is inner or left."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(and_, [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def lookup_join(
    left: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    rows: str | None = None,
    sized: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``left`` to data with one or few rows per key; NULL keys meet NULL keys.

    Where the row count of each key is known anyway, as column ``rows`` of ``sized``
    (one row per key) or of ``per_key`` itself, a key of more than ``rows_per_task``
    rows gets as many salts as keep tasks near that size, and its rows of ``per_key``
    are repeated that often; other keys stay as they are. The list of such keys is an
    ordinary side of a join, whatever its length. ``spread`` names the left columns
    whose hash picks the salt, so a task that is run again picks the same one. Without
    counts it is a plain join, which adaptive execution splits if a key is hot.
    """
    if rows is None:
        return null_safe_join(left, per_key, on, how)
    n = F.col(rows)
    counted = per_key if sized is None else sized
    hot = counted.where(n > rows_per_task).select(*on, F.ceil(n / rows_per_task).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    salted = null_safe_join(left, hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")
    )
    copies = null_safe_join(per_key, hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return null_safe_join(salted.drop("_salts"), copies.drop("_salts"), [*on, "_salt"], how).drop("_salt")


# Columns of a table made by ``cut_ranges``: number of the range, and an order among equal rows.
PART, TIE = "_part", "_tie"


def cut_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows dealt to ranges of (keys, order), written, with the number of their range.

    A sample sets the borders. Equal rows are told apart by ``_tie``, so a range holds its
    share of the rows even where one key, or one key and one place, holds all of them.
    The written table fixes ranges and ties for every later use. NULLs come first.
    """
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    by = [*keys, *order, TIE]
    ranged = tied.repartitionByRange(parts, *by) if parts else tied.repartitionByRange(*by)
    return written(ranged.withColumn(PART, F.spark_partition_id()), "ranges")


# Per kind of fold: aggregate over rows, and how two results in a row combine.
_FOLDS = {
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "xor": (F.bit_xor, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a.bitwiseXOR(b))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "newest": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def scan_ranges(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: dict[str, tuple[str, str]],
    backward: bool = False,
) -> DataFrame:
    """Running values per key over a table of ``cut_ranges``, exact for keys of any size.

    ``folds`` maps each new column to (kind, column): ``count``, ``sum``, ``xor``, ``max``
    and ``newest`` (last value that is not NULL) run from the first row of the key to this
    one, ``lag`` is the value of the row before. ``backward`` runs from the last row instead.
    Each range is scanned alone; a key that goes on in another range leaves one row of totals
    there, so what is carried has fewer rows than there are ranges, and its join is
    a broadcast by its measured size.
    """
    parts = [*keys, PART]
    places = [*order, TIE]
    turned = F.desc if backward else F.asc
    w = Window.partitionBy(*parts).orderBy(*[turned(c) for c in places])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    outermost = F.min_by if backward else F.max_by
    totals, inner, carries = [], [], []
    before = (
        Window.partitionBy(*keys).orderBy(turned(PART)).rowsBetween(Window.unboundedPreceding, -1)
    )
    for name, (kind, column) in folds.items():
        if kind == "lag":
            inner.append(F.lag(F.struct(column)).over(w).alias(name))
            totals.append(outermost(F.struct(column), F.struct(*places)).alias(name))
            carries.append(F.last(name).over(before).alias(f"_carry_{name}"))
            continue
        fold = _FOLDS[kind][0]
        inner.append(fold(column).over(upto).alias(name))
        if kind == "newest":
            held = F.when(F.col(column).isNotNull(), F.struct(*places))
            totals.append(outermost(F.col(column), held).alias(name))
        else:
            totals.append(fold(column).alias(name))
        carried = F.sum if kind == "count" else fold
        carries.append(carried(F.col(name)).over(before).alias(f"_carry_{name}"))
    pieces = rows.groupBy(*parts).agg(*totals)
    carried = pieces.select(*parts, *carries, F.count(F.lit(1)).over(before).alias("_earlier"))
    carried = written(carried.where("_earlier > 0").drop("_earlier"), "carried")
    joined = null_safe_join(rows.select("*", *inner), carried, parts, "left")
    for name, (kind, column) in folds.items():
        carry = F.col(f"_carry_{name}")
        if kind == "lag":
            joined = joined.withColumn(name, F.coalesce(name, carry)[column])
        else:
            joined = joined.withColumn(name, _FOLDS[kind][1](carry, F.col(name)))
    return joined.drop(*[f"_carry_{name}" for name in folds])


# Time units a key is cut into, coarse to fine.
UNITS = ["day", "hour", "minute", "second"]


def bucketed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> tuple[DataFrame, Column, list[str]]:
    """(rows, bucket, order) for the helpers below, so that no key has more rows in a bucket than a task should hold.

    The bucket is the coarsest unit of the first order column that is fine enough, measured
    with one small aggregate per unit tried; the day nearly always is. Where even
    one second of one key is too much, rows are cut into ranges of (key, order) instead, which
    hold their share whatever the times. The choice affects speed only, never results.
    """
    rows = 0
    for unit in UNITS:
        bucket = F.date_trunc(unit, order[0])
        groups = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
        largest, rows = groups.agg(F.max("_n"), F.sum("_n")).first()
        if (largest or 0) <= rows_per_task:
            return df, bucket, list(order)
    parts = max(-(-rows // rows_per_task), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_ranges(df, keys, order, parts), F.col(PART), [*order, TIE]


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rn"
) -> DataFrame:
    """First ``k`` rows per key; Spark trims each map task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def lag_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: dict[str, str],
) -> DataFrame:
    """``lag`` per key, computed per (key, bucket) and carried across buckets.

    ``bucket`` must not decrease along ``order``. ``values`` maps each source
    column to the name of its lagged copy.
    """
    parts = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*parts).orderBy(*order)
    inner = rows.withColumn("_rn", F.row_number().over(w))
    for source, target in values.items():
        inner = inner.withColumn(target, F.lag(source).over(w))
    tails = rows.groupBy(*parts).agg(
        F.max_by(F.struct(*values.keys()), F.struct(*order)).alias("_tail")
    )
    carried = tails.select(
        *parts,
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"),
    )
    joined = null_safe_join(inner, carried, parts, "left")
    for source, target in values.items():
        joined = joined.withColumn(
            target,
            F.when(F.col("_rn") == 1, F.col("_carry")[source]).otherwise(F.col(target)),
        )
    return joined.drop("_bucket", "_rn", "_carry", PART, TIE)


def sessions_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gap: Column,
    bucket: Column,
    values: dict[str, str],
) -> DataFrame:
    """Session of each row: rows of a key no further apart than ``gap``.

    ``order`` starts with the time column. Adds ``is_start`` and
    ``session_start``, and lagged copies of ``values`` (NULL at a start). Rows
    are numbered within (key, bucket); one row per bucket tells whether its
    first row continues the session left open before it.
    """
    time, parts = order[0], [*keys, "_bucket"]
    w = Window.partitionBy(*parts).orderBy(*order)
    until_here = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = (
        df.withColumn("_bucket", bucket)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_mark", F.when(F.col(time) - F.lag(time).over(w) > gap, F.col(time)))
        .withColumn("_open", F.last("_mark", ignorenulls=True).over(until_here))
    )
    for source, target in values.items():
        inner = inner.withColumn(target, F.lag(source).over(w))
    ends = inner.groupBy(*parts).agg(
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.max("_mark").alias("_last_mark"),
        F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"),
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.withColumn(
            "_opens", F.coalesce(F.col("_first") - F.lag("_last").over(by_bucket) > gap, F.lit(True))
        )
        .withColumn("_newest", F.coalesce("_last_mark", F.when(F.col("_opens"), F.col("_first"))))
        .select(
            *parts,
            "_opens",
            F.when(F.col("_opens"), F.col("_first"))
            .otherwise(F.last("_newest", ignorenulls=True).over(before))
            .alias("_carry"),
            F.lag("_tail").over(by_bucket).alias("_before"),
        )
    )
    head = F.col("_rn") == 1
    joined = (
        null_safe_join(inner, carried, parts, "left")
        .withColumn("is_start", F.when(head, F.col("_opens")).otherwise(F.col("_mark").isNotNull()))
        .withColumn("session_start", F.coalesce("_open", "_carry"))
    )
    for source, target in values.items():
        previous = F.when(head, F.col("_before")[source]).otherwise(F.col(target))
        joined = joined.withColumn(target, F.when(~F.col("is_start"), previous))
    return joined.drop("_bucket", "_rn", "_mark", "_open", "_opens", "_carry", "_before", PART, TIE)


def index_in_buckets(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, target: str
) -> DataFrame:
    """Zero-based position of each row within its key."""
    parts = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    inner = rows.withColumn("_rn", local)
    return (
        null_safe_join(inner, offsets, parts, "left")
        .withColumn(target, F.col("_offset") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_offset", PART, TIE)
    )


def previous_rows_stats(
    indexed: DataFrame,
    keys: Sequence[str],
    index: str,
    value: str,
    n: int,
    block_rows: int = 65536,
) -> DataFrame:
    """Count, mean and sample deviation of ``value`` over the ``n`` rows before each row.

    Rows are cut into blocks of ``block_rows``; the last ``n`` rows of a block
    are repeated at the head of the next one, so each block is independent.
    """
    block_rows = max(block_rows, n)
    block = F.floor(F.col(index) / block_rows)
    near_end = F.col(index) % block_rows >= block_rows - n
    copies = indexed.withColumn("_home", block).withColumn(
        "_block",
        F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(-n, -1)
    return (
        copies.withColumn("prev_n", F.count(value).over(frame))
        .withColumn("prev_mean", F.avg(value).over(frame))
        .withColumn("prev_sd", F.stddev_samp(value).over(frame))
        .where(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )


# Brackets reach this many times the sketch's rank error to either side.
BRACKET = 3.0


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Continuous percentiles per key, exact, without one task holding a whole key.

    A mergeable sketch gives a narrow bracket around each percentile. Rows
    outside all brackets are only counted per gap between brackets (map-side
    combined); rows inside one, about ``6 / accuracy`` of the key and
    percentile, are counted per distinct value. Those counts are ranked per key or, where a
    key has more of them than a task should hold, over ranges of (key, value). Should a
    sketch err beyond its bracket, all distinct values of that key are ranked instead.
    Output: keys plus ``p0, p1, ...`` in the order of ``fractions``.
    """
    margin = BRACKET / accuracy
    points: list[float] = []
    for p in fractions:
        points += [max(p - margin, 0.0), min(p + margin, 1.0)]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", points, accuracy).alias("_q"),
    )
    lows = [F.col("_q")[2 * i] for i in range(len(fractions))]
    highs = [F.col("_q")[2 * i + 1] for i in range(len(fractions))]
    inside = reduce(or_, [F.col("_v").between(lo, hi) for lo, hi in zip(lows, highs)])
    gap = reduce(add, [(F.col("_v") > hi).cast("int") for hi in highs])
    sized = lookup_join(rows, sketch, keys, ["_v"], "inner", rows="_n")
    ends = written(
        _values_at_ranks(sized, keys, F.when(inside, F.col("_v")), F.when(~inside, gap), fractions), "percentiles"
    )
    missed = ends.where("_missed").select(*keys)
    if not missed.isEmpty():
        again = null_safe_join(rows, missed.withColumn("_again", F.lit(True)), keys, "inner").drop("_again")
        again = lookup_join(again, sketch.drop("_q"), keys, ["_v"], "inner", rows="_n")
        whole = _values_at_ranks(again, keys, F.col("_v"), F.lit(None).cast("int"), fractions)
        ends = ends.where("not _missed").unionByName(whole)
    position = [F.lit(float(p)) * (F.col("_n") - 1) for p in fractions]
    return ends.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (at - F.floor(at)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"p{i}")
            for i, at in enumerate(position)
        ],
    )


def _values_at_ranks(
    rows: DataFrame, keys: Sequence[str], exact: Column, gap: Column, fractions: Sequence[float]
) -> DataFrame:
    """Per key the values at the ranks below and above each fraction, ``_missed`` where one lies inside a gap.

    ``rows`` carry the rows of their key as ``_n``; each is counted under its value ``exact``, or else its ``gap``.
    """
    counted = (
        rows.groupBy(*keys, "_n", exact.alias("_at"), gap.alias("_gap"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    counted = written(counted, "value-counts")
    # Groups do not overlap: ordered by their smallest value, counts add up to ranks.
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    if (sizes.agg(F.max("_s")).first()[0] or 0) > ROWS_PER_TASK:
        running = scan_ranges(cut_ranges(counted, keys, ["_min"]), keys, ["_min"], {"_upto": ("sum", "_c")})
    else:
        running = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_min")))
    ranked = running.withColumn("_end", F.col("_upto") - 1).withColumn("_start", F.col("_upto") - F.col("_c"))
    known = (
        lambda rank: F.when((F.col("_min") == F.col("_max")) | (rank == F.col("_start")), F.col("_min"))
        .when(rank == F.col("_end"), F.col("_max"))
    )
    values, unknown = [], []
    for i, p in enumerate(fractions):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for name, rank in ((f"_lo{i}", F.floor(at)), (f"_hi{i}", F.ceil(at))):
            here = (F.col("_start") <= rank) & (rank <= F.col("_end"))
            values.append(F.max(F.when(here, known(rank))).alias(name))
            unknown.append(F.max(here & known(rank).isNull()))
    return ranked.groupBy(*keys, "_n").agg(*values, reduce(or_, unknown).alias("_missed"))
