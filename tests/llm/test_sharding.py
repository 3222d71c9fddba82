import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigilframe.llm import sharding
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES


def rows(docs, shards=5, **options):
    path = sharding.write_shards(docs, shards, **options)
    return sharding.shard_table(docs, path).collect()


def gapless(found):
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("bucket_bytes", [200, 1 << 20])
def test_edges(edges, clashing, nothing, bucket_bytes):
    for docs in (edges, clashing):
        found = rows(docs, bucket_bytes=bucket_bytes)
        assert gapless(found)
        key = lambda r: (str(r[0]), str(r[1]))
        assert sorted((key(r["record"]) for r in found)) == sorted(key(r) for r in EDGES)
        assert list(found[0]["record"].asDict()) == docs.columns
    assert rows(nothing) == []


def test_same_id_same_shard_and_same_order_again(edges):
    first = rows(edges)
    assert len({r["shard"] for r in first if r["record"]["doc_id"] == 1}) == 1
    place = lambda found: sorted((r["shard"], r["slot"], str(r["record"])) for r in found)
    assert place(first) == place(rows(edges))


def test_query_law_and_digests(spark, documents):
    found = QUERIES["op1_sharding"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    assert gapless(found)
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS)
    assert {r["shard"] for r in found} <= set(range(40))
    assert any(r["grown_shard"] == sharding.SHARDS for r in found)


def test_one_id_with_many_rows_spreads_over_buckets(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    path = sharding.write_shards(docs, 3, bucket_bytes=4096)
    sizes = spark.read.parquet(path).groupBy("shard", "bucket").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 1000
    assert gapless(sharding.shard_table(docs, path).collect())
