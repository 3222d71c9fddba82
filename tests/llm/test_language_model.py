import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigilframe.llm import language_model as L
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES


def tokens(text):
    return (text or "").encode().lower().split() + [None]


class Plain:
    """The same model over dictionaries."""

    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for x in texts:
            t = tokens(x)
            self.c.update(t)
            self.b.update(zip([b"<start>", *t[:-1]], t))
        self.before = Counter(w for _, w in self.b)
        kinds, words = Counter(self.b.values()), Counter(self.before.values())
        self.d = L._discounts([kinds[i] for i in (1, 2, 3, 4)])
        self.e = L._discounts([words[i] for i in (1, 2, 3, 4)])
        self.after = defaultdict(Counter)
        for (u, _), n in self.b.items():
            self.after[u][min(n, 3)] += 1
            self.after[u]["all"] += n
        self.n, self.v = sum(self.c.values()), len(self.c)
        pairs = max(1, len(self.b))
        left = sum(self.e[min(n, 3)] for n in self.before.values()) / pairs if self.b else 1.0
        self.lower = lambda w: max(self.before[w] - self.e[min(self.before[w], 3)], 0) / pairs + left / (self.v + 1)

    def p(self, u, w):
        if u not in self.after:
            return self.lower(w)
        h, n = self.after[u], self.b[u, w]
        gamma = sum(self.d[i] * h[i] for i in (1, 2, 3)) / h["all"]
        return (n - self.d[min(n, 3)]) / h["all"] + gamma * self.lower(w)

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        score = sum(math.log10(self.p(u, w)) for u, w in zip([b"<start>", *t[:-1]], t))
        return len(t), sum(self.c[w] > 0 for w in t), self.n, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9)


COLUMNS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("file_rows", [1 << 19, 500])
def test_edges_equal_the_plain_model(edges, clashing, nothing, file_rows):
    for docs in (edges, clashing):
        folder = L.train(docs, file_rows)
        plain = Plain([t for _, t, _ in EDGES])
        found = L.with_scores(docs.select("doc_id", "text", F.col("text").alias("copy")), folder, ["doc_id", "copy"]).collect()
        assert len(found) == len(EDGES)
        for r in found:
            assert tuple(r[c] for c in COLUMNS) == plain.row(r["copy"])
    empty = L.train(nothing)
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in L.with_scores(edges, empty, ["doc_id"]).collect())
    assert L.with_scores(nothing, folder, ["doc_id"]).count() == 0


def test_probabilities_add_up_to_one():
    plain = Plain(["a b a b c", "b c d", "a a a", ""])
    words = [*plain.c, "unseen"]
    for u in [b"<start>", b"a", b"d", b"never"]:
        assert sum(plain.p(u, w) for w in words) == pytest.approx(1.0)


def test_flushes_do_not_change_the_model(documents, monkeypatch):
    monkeypatch.setattr(L, "HELD_TOKENS", 1000)
    folder = L.train(documents, 2000)
    plain = Plain([r["text"] for r in documents.collect()])
    rows = L.with_scores(documents, folder, ["text"]).limit(20).collect()
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == plain.row(r["text"])


def test_query(spark, documents):
    rows = documents.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([r["text"] for r in rows if not held(r["doc_id"])])
    found = {r["doc_id"]: r for r in QUERIES["op5_language_model"](spark, DATA).collect()}
    assert len(found) == len(rows)
    for r in rows:
        got = found[r["doc_id"]]
        assert got["held_out"] == held(r["doc_id"])
        assert tuple(got[c] for c in COLUMNS) == plain.row(r["text"])
