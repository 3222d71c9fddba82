import math

import numpy as np
import pandas as pd
import pytest

from vigilframe.llm import language_id as lid
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES


def brute_bits(texts_of, text, order=lid.ORDER):
    """Code length of ``text`` byte by byte, over trees kept as dictionaries."""
    trees = {}
    for t in texts_of:
        data = b"\0" * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                tree = trees.setdefault(data[i - k : i], {})
                tree[data[i]] = tree.get(data[i], 0) + 1
    data, total = b"\0" * order + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            tree = trees.get(data[i - k : i])
            if tree is None:
                continue
            whole = sum(tree.values()) + len(tree)
            if data[i] in tree:
                total += math.log2(whole / tree[data[i]])
                break
            total += math.log2(whole / len(tree))
        else:
            total += 8
    return total


def test_code_lengths_equal_plain_trees():
    texts = {"a": ["the cat sat", "the hat"], "b": ["le chat était là", "été"]}
    rows = []
    for lang, ts in texts.items():
        grams, n = np.unique(np.concatenate([lid._grams([t.encode()])[0] for t in ts]), return_counts=True)
        rows.append(pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n}))
    trees = lid.ContextTrees(["a", "b"], pd.concat(rows))
    tried = ["the cat", "", "été là", "zzz qq", "x", "le hat", "t\x00\x00t"]
    got = trees.bits([t.encode() for t in tried])
    for t, bits in zip(tried, got):
        for lang, value in zip(texts, bits):
            assert value == pytest.approx(brute_bits([x.encode() for x in texts[lang]], t.encode()), abs=1e-3)


def test_rare_languages_keep_all_paths(spark):
    """A language ten times rarer than 130,000 paths of another is still told apart."""
    rng = np.random.default_rng(2)
    hot = "".join(map(chr, rng.integers(0x4E00, 0x9000, 70_000)))
    docs = spark.createDataFrame([(i, hot, "hot") for i in range(3)] + [(9, "ein kleiner satz", "rare")], "doc_id long, text string, lang string")
    trees = lid.train(docs)
    assert trees.langs == ["hot", "rare"]
    assert trees.bits(["kleiner satz".encode()])[0].argmin() == 1
    want = [len(np.unique(lid._grams([t.encode()])[0])) for t in (hot, "ein kleiner satz")]
    assert [len(tree.levels[0][1]) for tree in trees.trees] == want and want[0] > 100_000


def test_edges(edges, clashing, nothing):
    for docs in (edges, clashing):
        trees = lid.train(docs)
        found = lid.predict(docs, trees, ["doc_id"]).collect()
        assert len(found) == len(EDGES)
        pred = {r["doc_id"]: r["lang_pred"] for r in found}
        assert pred[2] == pred[3] == pred[5] == pred[6] == "und"
        assert pred[1] == "en" and pred[4] == "de"
        kept = lid.accepted(docs)
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "4", "7", "None"]
    assert lid.train(nothing) is None
    assert lid.predict(nothing, None, ["doc_id"]).count() == 0
    assert lid.accepted(nothing).count() == 0
    assert {r["lang_pred"] for r in lid.predict(edges, None, ["doc_id"]).collect()} == {"und"}


def random_words(rng, letters, words, length):
    return " ".join("".join(rng.choice(list(letters), length)) for _ in range(words))


def test_gibberish_goes_and_texts_with_keys_stay(spark):
    """Random strings go, labelled or not, copied or not; short clean texts that hold keys or numbers stay."""
    documents = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = [random_words(rng, alnum, 1, 400) for _ in range(50)]
    noise += [random_words(rng, lower, 1, 60) for _ in range(20)] + [random_words(rng, lower, 12, 5) for _ in range(20)]
    clean = [r["text"] for r in documents.where("lang = 'en'").limit(60).collect()]
    short = [" ".join(t.split()[:4]) for t in clean if t]
    keyed = [f"{t} token = {random_words(rng, alnum + '0123456789' * 5, 1, 40)}7" for t in short]
    base = documents.select("doc_id", "text", "lang")
    rows = [(10**6 + i, t, "en" if i % 2 else None) for i, t in enumerate(noise)]
    rows += [(r[0] + 10**3, *r[1:]) for r in rows] + [(2 * 10**6 + i, t, "en") for i, t in enumerate(keyed)]
    kept = {r["doc_id"] for r in lid.accepted(base.union(spark.createDataFrame(rows, base.schema))).collect()}
    assert not [i for i in range(len(noise)) if {10**6 + i, 10**6 + i + 1000} & kept]
    assert all(2 * 10**6 + i in kept for i in range(len(keyed)))
    lettered = {r["doc_id"] for r in base.where(base["text"].rlike(r"\p{L}")).collect()}
    assert lettered <= kept


def test_counts_of_shared_paths(spark):
    rows = [("aaaab", "x"), ("aaaab", "x"), ("aaaac", "x"), ("aaaac", "y"), ("", "x"), (None, "x"), ("aaaac", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["lang"], r["gram"].to_bytes(4, "big").strip(b"\0").decode()): r["n"] for r in lid.count_paths(docs).collect()}
    assert got["x", "aaaa"] == 3 and got["x", "aaab"] == 2 and got["y", "aaac"] == 1 and got["x", "a"] == 3
    shared = {(r["lang"], r["gram"].to_bytes(4, "big").strip(b"\0").decode()): r["n"] for r in lid.count_paths(docs, plain=True).collect()}
    assert shared == {("x", k): 3 for k in ("a", "aa", "aaa", "aaaa")}


def test_limits(spark):
    schema = "lang string, lang_pred string, bits_per_byte double"
    rows = [("a", "a", 2.0 + i / 100) for i in range(100)] + [("b", "b", 9.0)] * 4 + [("b", "a", 16.0), (None, "a", 16.0)] * 99
    got = lid.clean_limits(spark.createDataFrame(rows, schema))
    assert got["a"] == pytest.approx(2.5 + 4, abs=0.05) and "b" not in got and got["und"] < 8
    assert lid.clean_limits(spark.createDataFrame(rows[:4], schema)) == {}


def test_letters():
    assert lid.letters("See key=ab12 NOW!! (été9)") == "see now été"
    assert lid.letters("ÉTÉ\u00a09 à%%% é7") == "été à é"
    assert lid.letters("Ab12 99") == "ab12 99"
    assert lid.letters("") == ""
    assert len(lid.letters("a" * 2_000_000)) == 2_000_000


def test_held_out_accuracy(spark, documents):
    found = QUERIES["op4_language_id"](spark, DATA).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
