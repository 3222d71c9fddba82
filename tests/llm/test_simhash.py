import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilframe.llm import simhash
from vigilframe.llm.common import QUERIES
from vigilframe.llm.components import component_labels

from .conftest import DATA, EDGES


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """Smallest id reachable, over (id, fingerprint) pairs."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, least.get(root(i))) for i, (doc, _) in enumerate(fps)]


def test_fingerprints():
    for text in [t for _, t, _ in EDGES] + ["a", "a b", "A B c D", "a\x0bb\x1cc d e", "ß É x y"]:
        assert simhash.fingerprint(text) == brute_fp(text)


def test_spark_hash_agrees(spark):
    got = spark.sql("select xxhash64('some three words') h").first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"some three words", 42)


@pytest.mark.parametrize("count", [10, 10**7, 10**12])
def test_links_find_every_near_pair(spark, count, monkeypatch):
    rng = random.Random(count)
    fps = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(5):
            fps.add(seed)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                seed ^= 1 << bit
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    masks = simhash.shard_keys(count)
    monkeypatch.setattr(simhash, "shard_keys", lambda n, radius: masks)
    links = simhash.close_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    labels = {r["node"]: r["label"] for r in component_labels(links).collect()}
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    groups = {}
    for (i, first), s in zip(want, signed):
        groups.setdefault(labels.get(s, s), set()).add(first)
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({f for _, f in want})


def test_edges(edges, clashing, nothing):
    want = sorted(brute_components([(d, brute_fp(t)) for d, t, _ in EDGES]), key=str)
    got = [(r[0], r[1]) for r in simhash.near_duplicates(edges).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == want
    assert simhash.near_duplicates(clashing).count() == len(EDGES)
    assert simhash.near_duplicates(nothing).count() == 0
    stay = simhash.one_per_group(clashing)
    assert stay.columns == clashing.columns
    assert stay.count() == len({brute_fp(t) for _, t, _ in EDGES})
    assert sorted(r["doc_id"] for r in stay.where("doc_id <= 3").collect()) == [1, 2]
    assert simhash.one_per_group(nothing).count() == 0


def test_query(spark, documents):
    docs = documents.select("doc_id", "text").collect()
    fps = [(r["doc_id"], brute_fp(r["text"])) for r in docs]
    found = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, DATA).collect()}
    assert {d: found[d]["fingerprint"] for d, _ in fps} == {d: f"{f:016x}" for d, f in fps}
    assert {d: found[d]["component_id"] for d, _ in fps} == dict(brute_components(fps))


def test_long_chain_is_one_component(spark):
    n = 300
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = component_labels(links).collect()
    assert len(labels) == n + 1 and {r["label"] for r in labels} == {0}
