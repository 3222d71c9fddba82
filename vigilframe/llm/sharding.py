"""Sharding: a two-pass external shuffle into shards (native Spark only).

Pass one scatters every record uniformly into memory-sized buckets with seeded
hashes; pass two shuffles each bucket by Fisher-Yates (Spark's seeded ``shuffle``
of an array) and writes it. A bucket belongs to one shard, so the buckets of a
shard, one after the other, are the shard in random order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import new_table_path, query, table

SHARDS = 40
BUCKET_BYTES = 16 << 20
SEED = 20240131


def record_bytes(text) -> F.Column:
    """UTF-8 bytes of the text (none for NULL) plus 16 for the other fields."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shard_of(doc_id, shards: int) -> F.Column:
    """Rendezvous hashing: the shard whose seeded hash with the id is largest.

    Only the id and the number of shards decide. With one more shard, a row either
    stays where it is or goes to the new one.
    """
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    scores = F.array(*[F.xxhash64(key, F.lit(SEED + s)) for s in range(shards)])
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def write_shards(
    docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> str:
    """Write the records as shards below the shared folder; returns the folder.

    Layout: ``shard=<n>/`` holding bucket, place, shard, size and ``record``, a
    struct of all columns of ``docs`` (so no column name can clash). Columns must
    be orderable (no maps).

    A shard's number of buckets follows from its bytes. The bucket of a row is a
    seeded hash of the whole record and of its place among equal hashes' salts, so a
    text or id that holds a third of all rows spreads over all buckets of its
    shard; an id that repeats without end fills its shard, as the id decides it.
    The array is sorted before it is shuffled, so a task that runs again after a
    lost executor writes the same order. NULL texts count 16 bytes; a NULL id is an
    id like any other; an empty table gives an empty folder.
    """
    spark = docs.sparkSession
    rows = docs.select(
        shard_of(docs["doc_id"], shards).alias("shard"),
        record_bytes(docs["text"]).alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
    )
    sizes = (
        docs.select(shard_of(docs["doc_id"], shards).alias("s"), record_bytes(docs["text"]).alias("b"))
        .groupBy("s")
        .agg(F.sum("b").alias("bytes"))
        .collect()
    )  # one row per shard: bounded by the number of shards
    buckets = {r["s"]: max(1, -(-r["bytes"] // bucket_bytes)) for r in sizes}
    n_buckets = F.lit(1)
    if buckets:
        flat = [F.lit(x) for pair in sorted(buckets.items()) for x in pair]
        n_buckets = F.create_map(*flat)[F.col("shard")]
    # Equal rows are told apart by where they were read, which only moves equal rows.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    scattered = rows.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "record.doc_id", "record.text", salt), n_buckets).cast("int")
    )
    total = sum(buckets.values())
    shuffled = (
        scattered.repartition(max(1, total), "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("record", "size"))).alias("rows"))
        .select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
        .select("bucket", "place", "row.size", "row.record", F.col("shard").alias("shard_no"), "shard")
    )
    path = new_table_path(spark, "shards")
    shuffled.write.partitionBy("shard").parquet(path)
    return path


def shard_table(docs: DataFrame, path: str, *wanted: F.Column) -> DataFrame:
    """Rows of written shards with ``slot``, the gapless position within the shard.

    ``wanted``: expressions over ``record``; by default ``record`` itself.
    """
    spark = docs.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"bucket int, place int, size long, record struct<{fields.replace('` ', '`: ')}>, shard_no int"
    rows = spark.read.schema(schema).parquet(path)
    before = Window.partitionBy("shard_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket, so the window is small whatever a shard holds.
    offsets = (
        rows.groupBy("shard_no", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    wanted = wanted or (F.col("record"),)
    # Only what is asked for moves with the join.
    lean = rows.select("shard_no", "bucket", "place", "size", F.struct(*wanted).alias("wanted"))
    return lean.join(offsets, ["shard_no", "bucket"]).select(
        "wanted.*", "size", F.col("shard_no").alias("shard"), (F.col("offset") + F.col("place")).alias("slot")
    )


@query("op1_sharding")
def op1_sharding(spark, folder):
    """All documents in 40 shards under the ``key`` law, derived from the written shards."""
    docs = table(spark, folder, "documents")
    rows = shard_table(
        docs,
        write_shards(docs),
        F.col("record.doc_id").alias("doc_id"),
        F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
