import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vigilframe.llm import pii
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def base(df):
    return {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", pii.joined(F.col("_base"))).collect()}


HARD = [
    "a@b.c_d@e.f x@y z@q..r é@é.fr .@-.-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3 999.1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111222233334444",
    "+1 (988) 555-2485, ++49 30 123456 +1234 +1 (2",
    "日本語 a@b.co 😀 +44 20 7946 0958. 10.0.0.1😀",
    "aaaa" * 5000 + "@",
    "1" * 20000,
    "1.1.1.1@1.1.1.1",
]


def test_base_spans_equal_plain_regex(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    assert base(pii.find_pii(docs)) == {(i, t): brute(t) for i, t in enumerate(HARD)}


def test_edges(edges, clashing, nothing):
    for docs in (edges, clashing):
        found = pii.find_pii(docs)
        assert found.count() == len(EDGES)
        assert base(found)[1, EDGES[0][1]] == brute(EDGES[0][1]) != ""
    assert pii.find_pii(nothing).count() == 0


def test_redact(spark, edges, clashing):
    text = "Mail a@b.org or call +1 (988) 555-2485, password=abc12345 now"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "nothing here", 12)], "doc_id long, text string, n_chars long")
    found = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert found[1]["text"].startswith("Mail <EMAIL> or call <PHONE>,")
    assert found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] is None and found[3]["text"] == "nothing here"
    assert pii.redact(clashing).columns == clashing.columns


def test_long_secrets_go_whole(spark):
    rows = [(i, f"see token = {'k3Yq9' * n} end") for i, n in enumerate([2, 160, 1000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).collect()] == ["see <SECRET> end"] * 3


def test_query(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = QUERIES["op2_pii"](spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in PATTERNS] == [want.count(k + ":") for k in PATTERNS]


def test_reliability_finds_the_careless_labeler(spark):
    """Two labelers agree with a hidden truth, one votes at random."""
    import random

    rng = random.Random(1)
    votes = []
    for _ in range(2000):
        truth = 1 if rng.random() < 0.4 else -1
        votes.append([truth if rng.random() < 0.95 else -truth for _ in range(3)] + [rng.choice([1, -1])])
    rows = spark.createDataFrame([(v, 1) for v in votes], "votes array<int>, n int").groupBy("votes").agg(F.sum("n").alias("n"))
    prior, rates = pii.labeler_reliability(rows, 4)
    assert prior == pytest.approx(0.4, abs=0.05)
    assert all(r[1][0] > 0.9 and r[1][1] < 0.1 for r in rates[:3])
    assert abs(rates[3][1][0] - rates[3][1][1]) < 0.1
