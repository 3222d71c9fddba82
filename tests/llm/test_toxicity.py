import numpy as np
import pytest

from vigilframe.llm import toxicity as T
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n1 = labels.sum()
    return (ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


def test_logits_equal_all_pairs():
    machine = T.FactorizationMachine(bits=10, factors=3)
    machine.linear[:] = np.random.default_rng(1).normal(size=1 << 10)
    terms, counts = T.term_ids([b"a b c a", b"", b"d"], 10)
    got, at = machine.logits(terms, counts), 0
    for n, value in zip(counts, got):
        ids = terms[at : at + n]
        at += n
        pairs = sum(machine.factors[i] @ machine.factors[j] for k, i in enumerate(ids) for j in ids[:k])
        assert np.isclose(value, machine.linear[ids].sum() + pairs / max(n, 1), atol=1e-5)


def test_learns_a_pair_that_no_sum_of_words_explains(spark):
    """Toxic only if both words or neither occur: additive weights cannot tell."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        a, b = rng.random(2) < 0.5
        noise = [f"n{x}" for x in rng.integers(0, 20, 4)]
        rows.append((i, " ".join(noise + ["fool"] * bool(a) + ["group"] * bool(b)), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = T.train(docs)
    terms, counts = T.term_ids([t.encode() for _, t, _ in rows])
    assert auc(machine.logits(terms, counts), np.array([y for *_, y in rows])) > 0.95


@pytest.mark.parametrize("noise", [50, 200, 500])
def test_learns_a_pair_among_many_terms(spark, noise):
    """The same pair among as many other terms as real texts have, judged on texts held out."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        a, b = rng.random(2) < 0.5
        others = [f"n{x}" for x in rng.integers(0, 10 * noise, noise)]
        rows.append((i, " ".join(others + ["fool"] * bool(a) + ["group"] * bool(b)), int(a == b)))
    machine = T.train(spark.createDataFrame(rows[:3000], "doc_id long, text string, toxic int"))
    terms, counts = T.term_ids([t.encode() for _, t, _ in rows[3000:]])
    labels = np.array([y for *_, y in rows[3000:]])
    assert auc(machine.logits(terms, counts), labels) > 0.9
    machine.factors[:] = 0
    assert auc(machine.logits(terms, counts), labels) < 0.6


def test_pair_sums_cover_all_pairs(monkeypatch):
    monkeypatch.setattr(T, "PAIR_STEP", 3)
    texts = [[0, 1, 3], [1, 2, 3, 4], [], [0, 4], [0, 1, 2, 3, 4]]
    value = np.array([1.0, 2.0, 4.0, 8.0, 16.0])
    terms, counts = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    bounds = np.append(0, np.cumsum(np.bincount(terms)))
    got = np.concatenate([T.pair_sums(a, b, 5, terms, counts, np.argsort(terms, kind="stable"), bounds, [value])[0] for a, b in ((0, 2), (2, 5))])
    want = np.zeros((5, 5))
    for t, v in zip(texts, value):
        for k, a in enumerate(t):
            for b in t[k + 1 :]:
                want[a, b] += v
    assert (got == want).all()


def test_edges(spark, edges, clashing, nothing):
    machine = T.FactorizationMachine()
    for docs in (edges, clashing):
        found = T.with_score(docs, machine, ["doc_id"]).collect()
        assert len(found) == len(EDGES) and all(0 <= r["score"] <= 1 for r in found)
    assert T.with_score(nothing, machine, ["doc_id"]).count() == 0
    labelled = spark.createDataFrame([(1, None, 1), (2, "x", None)], "doc_id long, text string, toxic int")
    assert T.train(labelled).bias == 0.0
    assert T.train(labelled.limit(0)).bias == 0.0


def test_query(spark, documents):
    found = QUERIES["op7_toxicity"](spark, DATA).collect()
    assert len(found) == documents.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op7_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.7
    clean = rows[rows["toxic"] == 0]
    assert clean["predicted"].mean() < 0.02


def test_terms_left_out_are_in_no_strong_pair(spark, monkeypatch):
    """The bound drops most terms, and no pair that the whole test finds."""
    rng = np.random.default_rng(12)
    n = 4000
    lists = [np.unique(rng.integers(0, 40_000, rng.integers(5, 40))) for _ in range(n)]
    one, two = rng.random(n) < 0.3, rng.random(n) < 0.3
    held = [[t for t, h in ((40_001, a), (40_002, b)) if h] for a, b in zip(one, two)]
    lists = [np.append(x, h).astype(np.int64) for x, h in zip(lists, held)]
    labels = (one == two).astype(float)
    terms, counts = np.concatenate(lists), np.array([len(x) for x in lists])
    kept = []
    rule = T.may_pair
    monkeypatch.setattr(T, "may_pair", lambda *a: kept.append(rule(*a)) or kept[-1])
    some = T.strong_pairs(spark, terms, counts, labels)
    monkeypatch.setattr(T, "may_pair", lambda numbers, *a: np.ones(numbers.max() + 1, bool))
    every = T.strong_pairs(spark, terms, counts, labels)
    assert kept[0].mean() < 0.5
    assert (40_001, 40_002) in set(zip(every["a"], every["b"]))
    order = ["a", "b"]
    assert some.sort_values(order).to_numpy().tolist() == every.sort_values(order).to_numpy().tolist()
