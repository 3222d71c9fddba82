"""Keyword search that leaves out postings, against scoring every posting."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vigilframe import session
from vigilframe.operators import search as S
from vigilframe.session import written


def corpus(spark, seed, docs, words, queries, length):
    """Words by rank, the first ones in nearly every document; some documents hold whole queries."""
    rng = random.Random(seed)
    word = lambda: f"w{int(words ** rng.random())}"
    asked = [(q, " ".join(word() for _ in range(rng.randint(1, length)))) for q in range(queries)]
    texts = []
    for d in range(docs):
        text = " ".join(word() for _ in range(rng.randint(1, 60)))
        if rng.random() < 0.15:
            text += " " + rng.choice(asked)[1] * rng.randint(1, 2)
        texts.append((d, text))
    index = written(S.build_index(spark.createDataFrame(texts, "doc_id long, text string")), "index")
    return index, spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("seed,length,k", [(1, 3, 3), (2, 40, 10), (3, 12, 1), (4, 12, 400)])
def test_pruned_results_equal_all_scores(spark, seed, length, k, monkeypatch):
    monkeypatch.setattr(S, "SEED_POSTINGS", 5)
    index, asked = corpus(spark, seed, 400, 2000, 25, length)
    want = sorted(map(tuple, S.top_k(S.keyword_scores(index, asked), k).collect()))
    search = S.KeywordSearch(index, asked, k)
    assert sorted(map(tuple, search.pruned().collect())) == want
    assert sorted(map(tuple, search.scanned().collect())) == want
    monkeypatch.setattr(S, "ROWS_PER_TASK", 50)
    assert sorted(map(tuple, S.KeywordSearch(index, asked, k).pruned().collect())) == want


def test_far_fewer_postings_are_scanned(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = written(S.build_index(spark_docs), "index")
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    search = S.KeywordSearch(index, asked, 3)
    plan = search.plan()
    scanned = plan.where("not later").agg(F.sum("scanned")).first()[0]
    assert scanned < 0.5 * search.postings_met
    want = sorted(map(tuple, S.top_k(S.keyword_scores(index, asked), 3).collect()))
    assert sorted(map(tuple, search.pruned().collect())) == want


def test_blocks_of_short_queries_are_skipped(spark):
    """One common and one rare word: only the best postings of the common word can matter."""
    rng = random.Random(5)
    texts = [(d, "common " * rng.choice([1, 1, 1, 2, 5]) + "x " * rng.randint(1, 50) + "rare " * (d % 40 == 0)) for d in range(2000)]
    index = written(S.build_index(spark.createDataFrame(texts, "doc_id long, text string")), "index")
    asked = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    search = S.KeywordSearch(index, asked, 5)
    row = search.plan().where("term = 'common'").first()
    assert row["later"] or row["scanned"] < row["df"] / 2
    want = sorted(map(tuple, S.top_k(S.keyword_scores(index, asked), 5).collect()))
    assert sorted(map(tuple, search.pruned().collect())) == want


def dealt_equals_all_scores(index, asked, k):
    want = sorted(map(tuple, S.top_k(S.keyword_scores(index, asked), k).collect()), key=str)
    assert sorted(map(tuple, S.KeywordSearch(index, asked, k).dealt().collect()), key=str) == want
    return want


@pytest.mark.parametrize("seed,length,k", [(1, 3, 3), (2, 40, 10), (3, 12, 1), (4, 12, 400)])
def test_dealt_results_equal_all_scores(spark, seed, length, k, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 1500)
    monkeypatch.setattr(S, "CHUNK_TERMS", 60)
    monkeypatch.setattr(S, "GROUP", 4)
    index, asked = corpus(spark, seed, 400, 2000, 25, length)
    dealt_equals_all_scores(index, asked, k)
    texts = index.groupBy(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "doc_len", "term").agg(F.sum("tf").alias("tf"))
    dealt_equals_all_scores(written(texts, "index"), asked.select(F.struct("query_id").alias("query_id"), "text"), k)


@pytest.mark.parametrize("group", [1, 64])
def test_dealt_ties_repeats_and_nulls(spark, monkeypatch, group):
    """Many copies of one text, repeated and unknown ids on both sides, a word in more rows than there are ids."""
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 100)
    monkeypatch.setattr(S, "CHUNK_TERMS", 2)
    monkeypatch.setattr(S, "GROUP", group)
    texts = [(d % 90, "same words here") for d in range(300)] + [(None, "same word"), (None, "rare same"), (200, "rare")]
    index = written(S.build_index(spark.createDataFrame(texts, "doc_id long, text string")), "index")
    asked = [(1, "same words"), (1, "same"), (2, "rare same"), (None, "rare"), (3, "absent"), (4, None), (5, "same")]
    rows = dealt_equals_all_scores(index, spark.createDataFrame(asked, "query_id long, text string"), 7)
    assert min(r[2] for r in rows) < 0 and {r[0] for r in rows} == {1, 2, 5, None}


def test_table_search_moves_no_card_text_and_no_row_per_question(spark, monkeypatch, tmp_path):
    from vigilframe.suite import search as queries
    from vigilframe.suite.base import QUERIES

    cards = [(f"c{i}", f"Revenue of {'france' if i % 7 == 0 else 'peru'} orders " * (1 + i % 3)) for i in range(60)]
    stored = spark.createDataFrame(cards, "id string, content string")
    nations = spark.createDataFrame([(n, name) for n, name in enumerate(["FRANCE", "PERU"])], "n_nationkey int, n_name string")
    nations.write.parquet(f"{tmp_path}/nation.parquet")
    spreads = []
    build = S.build_index
    monkeypatch.setattr(S, "build_index", lambda *a: spreads.append(a[3]) or build(*a))
    monkeypatch.setattr(S, "SCAN_ALL", 0)
    monkeypatch.setattr(S.KeywordSearch, "pruned", lambda self: pytest.fail("a row per question and posting"))
    monkeypatch.setattr(queries, "documents", lambda t: stored)
    found = QUERIES["i4_table_search"](spark, str(tmp_path)).collect()
    assert spreads == [False] and sorted((r["query_id"], r["rank"]) for r in found) == [(f"q{q}", r) for q in (0, 1) for r in range(1, 6)]
    assert all(int(r["doc_id"][1:]) % 7 == 0 for r in found if r["query_id"] == "q0")


def test_table_search_writes_cards_before_they_are_dealt_by_name(spark, monkeypatch):
    """So what cards are made from is off the disk when whole cards are shuffled; other queries over cards do not write them."""
    from vigilframe.suite import catalog
    from vigilframe.suite.base import QUERIES

    names = []
    monkeypatch.setattr(catalog, "written", lambda df, name: names.append((name, "table" in df.columns)) or written(df, name))
    found = QUERIES["i4_table_search"](spark, "/root/testdata/sf0.001")
    assert names == [("cards", True)]
    assert found.count() == 25 * 5
    QUERIES["c11_column_meanings"](spark, "/root/testdata/sf0.001")
    assert len(names) == 1


def test_nothing_asked_or_stored_is_dealt(spark):
    index = S.build_index(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, text string")
    assert S.KeywordSearch(index, asked, 3).dealt().count() == 0


def test_large_search_shuffles_no_row_per_query_and_posting(spark, monkeypatch):
    """Every query asks for a word of every document: only the best of each block leave its task."""
    monkeypatch.setattr(S, "SCAN_ALL", 0)
    texts = [(d, "common " * (1 + d % 9) + f"w{d}") for d in range(500)]
    index = written(S.build_index(spark.createDataFrame(texts, "doc_id long, text string")), "index")
    asked = spark.createDataFrame([(q, f"common w{q}") for q in range(40)], "query_id long, text string")
    monkeypatch.setattr(S.KeywordSearch, "pruned", lambda self: pytest.fail("a row per query and posting"))
    monkeypatch.setattr(S.KeywordSearch, "scanned", lambda self: pytest.fail("a row per query and posting"))
    assert S.keyword_search(index, asked, 3).count() == 40 * 3


def test_chunks_come_in_rounds(spark, monkeypatch):
    """Many chunks: a round deals the postings once per chunk of its own, not once per chunk of all."""
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 1500)
    monkeypatch.setattr(S, "CHUNK_TERMS", 20)
    monkeypatch.setattr(S, "GROUP", 4)
    index, asked = corpus(spark, 6, 300, 500, 40, 12)
    asked = asked.unionByName(spark.createDataFrame([(None, "w1 w2"), (3, "w1 w40")], asked.schema))
    want = dealt_equals_all_scores(index, asked, 3)
    kept, dealt = type(index).repartition, []
    monkeypatch.setattr(type(index), "repartition", lambda self, n, *by: dealt.append((n, self.count())) or kept(self, n, *by))
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 1)
    search = S.KeywordSearch(index, asked, 3)
    found = search.dealt()
    assert sorted(map(tuple, found.collect()), key=str) == want
    postings, queries = [n for _, n in dealt[::2]], [n for _, n in dealt[1::2]]
    assert len(postings) > 5 and len(set(postings)) == 1 and postings[0] <= index.count()
    blocks = dealt[0][0] // 2
    assert sum(queries) == blocks * search.weighted.count()


def shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def eventually(test):
    for _ in range(100):
        if test():
            return True
        time.sleep(0.1)
    return False


def test_written_tables_leave_no_shuffle(spark):
    rows = spark.range(1000).repartition(3, "id")
    before, setting = shuffles(spark), spark.conf.get(session.DROPS_SHUFFLES, None)
    tables = [written(rows, "some"), session.written_in_buckets(rows, "some", "id")]
    assert eventually(lambda: shuffles(spark) <= before)
    assert [t.count() for t in tables] == [1000, 1000] and spark.conf.get(session.DROPS_SHUFFLES, None) == setting


def test_nothing_asked_or_stored(spark):
    index = S.build_index(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, text string")
    assert S.keyword_search(index, asked, 3).count() == 0
    assert S.KeywordSearch(index, asked, 3).pruned().count() == 0
    some = S.build_index(spark.createDataFrame([(1, "a a B")], "doc_id long, text string"))
    assert sorted(map(tuple, some.collect())) == [(1, 3, "a", 2), (1, 3, "b", 1)]
    assert [r["doc_id"] for r in S.KeywordSearch(some, asked, 3).pruned().collect()] == [1]


# --- vectors ------------------------------------------------------------------------------


def clustered(spark, seed, n, dims=8, clusters=30):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = [(i, [x + rng.gauss(0, 0.03) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] + [1.0] * (dims - 1)), (n + 3, [1.0] * 3), (n + 4, [2.0] * 3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("k", [1, 60])
def test_grouped_vectors_give_all_neighbours(spark, k, monkeypatch):
    vectors = clustered(spark, 3, 600)
    asked = vectors.where("vec_id % 4 = 0 or vec_id >= 600").withColumnRenamed("vec_id", "query_id")
    search = S.VectorSearch(vectors, asked, k, "vec_id", "embedding")
    want = sorted(map(tuple, search.scanned().collect()))
    assert sorted(map(tuple, search.grouped(search.pivot_count()).collect())) == want
    monkeypatch.setattr(S, "ROWS_PER_TASK", 20)
    assert sorted(map(tuple, search.grouped(5).collect())) == want
    monkeypatch.setattr(S, "QUERIES_PER_PIVOT", 0)
    rows = S.vector_search(vectors, asked, k).collect()
    assert len(rows) == len(want) and {r["query_id"] for r in rows} == {*range(0, 600, 4), 603, 604}


def test_most_groups_are_skipped(spark):
    vectors = clustered(spark, 4, 1500)
    asked = vectors.where("vec_id < 300").withColumnRenamed("vec_id", "query_id")
    search = S.VectorSearch(vectors, asked, 3, "vec_id", "embedding")
    search.deal(40)
    _, rest = search.plan()
    compared = rest.agg(F.sum("n")).first()[0] + search.bounds.count()
    assert compared < 0.25 * 300 * 1500
