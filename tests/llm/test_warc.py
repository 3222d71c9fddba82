import base64
import hashlib
import random

from pyspark.sql import functions as F

from vigilframe.llm import warc
from vigilframe.llm.common import QUERIES

from .conftest import DATA

PAGES = [
    (1, "http://b.example.org/x", "<p>same</p>"),
    (2, "https://WWW.a.example.org/y?q=1", "<p>same</p>"),
    (5, "http://a.example.org/y", "<p>same</p>"),
    (5, "http://a.example.org/y", "<p>same</p>"),
    (3, None, None),
    (4, "", ""),
    (None, "http://a.example.org/", "<p>only</p>"),
    (None, "not a url [", "<p>same</p>"),
    (6, "http://a.example.org/z\r\nX-Evil: 1", "é" * 100_000 + "\r\n\r\nWARC/1.1"),
]


def captures(df):
    return warc.capture_index(warc.write_archives(df)).collect()


def test_edges(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for df in (pages, pages.withColumns({"digest": F.lit("x"), "file": F.lit("y"), "refers_to": F.lit(1)})):
        found = captures(df)
        assert len(found) == len(PAGES)
        kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=str)
        assert kinds == sorted(
            [(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (5, "response", None), (None, "revisit", 5),
             (3, "revisit", 4), (4, "response", None), (None, "response", None), (6, "response", None)],
            key=str,
        )
        for r in found:
            html = next(h or "" for i, _, h in PAGES if i == r["page_id"] and (i or len(h) + 0 == r["payload_bytes"]))
            data = html.encode()
            assert r["payload_bytes"] == len(data)
            assert r["page_id"] is None or r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert captures(pages.limit(0)) == []


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = warc.capture_index(warc.write_archives(pages, min_bytes=1000)).collect()
    assert {r["record_type"] for r in found} == {"response"}


def test_loser_tree_merges_like_sorted():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(((rng.randrange(20), i), None) for i in range(rng.randrange(30))) for _ in range(k)]
        assert [v for v in warc.LoserTree([[(x, (x, y)) for x, y in r] for r in runs])] == sorted(x for r in runs for x in r)


def test_global_order(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randrange(3)}.org/{rng.randrange(4)}", f"page {i}") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = captures(pages)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in found]
    assert keys == sorted(keys) and len(set(r["file"] for r in found)) > 1


def test_query(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = QUERIES["op8_warc"](spark, DATA).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    first = {}
    for i, data in pages.items():
        first[data] = max(i, first.get(data, i))
    for r in found:
        data = pages[r["page_id"]]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["payload_bytes"] == len(data)
        is_first = first[data] == r["page_id"]
        assert r["record_type"] == ("response" if is_first else "revisit")
        assert r["refers_to"] == (None if is_first else first[data])
