import numpy as np

from vigilframe.llm import nearest as N
from vigilframe.llm.common import QUERIES

from .conftest import DATA


def brute(rows, step=50, k=5):
    """Exact answer over (id, vector) rows that may take part."""
    rows = list({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, a in rows:
        if q % step == 0:
            a = np.array(a, float)
            scored = out.setdefault(q, {})  # an id with several vectors searches with each
            for i, b in rows:
                if i != q and len(b) == len(a):
                    b = np.array(b, float)
                    s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                    scored[i] = max(s, scored.get(i, -2.0))
    return {q: sorted(s.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k] for q, s in out.items()}


def answer(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_table_with_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(i, [1.0] * 8) for i in range(200, 240)] + [(7, rows[7][1]), (50, [2.0] * 8), (300, [1.0, 2.0])]
    bad = [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [None] * 8), (405, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got, want = answer(N.nearest(df)), brute(rows)
    found = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q, w in brute(rows, k=10**6).items() for i, s in w}
    for q, hits in got.items():
        assert len(hits) <= 5 and all(abs(exact[q, i] - s) < 1e-9 for i, s in hits)
    # Of forty equal vectors the smallest ids come first.
    assert [i for i, _ in got[200]] == want_ids(want[200])
    assert answer(N.nearest(df.limit(0))) == {}


def want_ids(hits):
    return [i for i, _ in hits]


def test_stray_dimensions_and_isolated_vectors(spark):
    """One longer vector spoils no other; isolated vectors have their neighbours too."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    near = [centres[i % 20] + 0.05 * rng.normal(size=16) for i in range(980)]
    rows = [(i, v.tolist()) for i, v in enumerate([*near, *rng.normal(size=(20, 16))])]
    rows = [(50 * i if i < 20 else i + 1000, v) for i, (_, v) in enumerate(rows[::-1])] + [(5000, [1.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answer(N.nearest(df)), brute(rows)
    found = sum(len(set(want_ids(got.get(q, []))) & set(want_ids(w))) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    assert all(len(got.get(50 * i, [])) == 5 for i in range(20))


def test_split_slots_give_the_same_answer(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    whole = answer(N.nearest(df))
    monkeypatch.setattr(N, "GROUP_ROWS", 20)
    split = answer(N.nearest(df))
    assert {q: want_ids(h) for q, h in whole.items()} == {q: want_ids(h) for q, h in split.items()}


def test_probes_come_in_order_of_cost():
    hashing = N.Hashing(4, 3, 1.0, tables=1)
    place = np.array([0.1, 5.5, -2.3])
    slots = hashing.probes(place, 27)
    assert slots[0].tolist() == [0, 5, -3] and len({tuple(s) for s in slots}) == len(slots) == 27
    inside = place - np.floor(place)
    steps = slots - np.floor(place)
    costs = np.where(steps < 0, inside, np.where(steps > 0, 1 - inside, 0)) ** 2
    assert (np.diff(costs.sum(1)) >= -1e-12).all()


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got, want = answer(QUERIES["op9_nearest"](spark, DATA)), brute(rows)
    found = sum(len(set(want_ids(got[q])) & set(want_ids(w))) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
