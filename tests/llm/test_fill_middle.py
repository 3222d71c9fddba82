import hashlib
import random

import pytest

from vigilframe.llm import fill_middle
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES


def brute(doc_id, text):
    """The contract, over Python strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{head}<S>{tail}<M>{middle}"


ALPHABET = "ab \n\té߀\U0001f600<PSM>"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cuts_of_code_points(block):
    rng = random.Random(block)
    for _ in range(200):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        tree = fill_middle.UnitTree(text.encode(), block=block)
        assert tree.n == tree.n_points == len(text)
        for k in range(len(text) + 1):
            assert tree.cut(k) == (len(text[:k].encode()), k)


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_of_other_units(unit):
    import re

    pattern = {"word": r"^[ \t\n]+|[^ \t\n]+[ \t\n]*", "line": r"[^\n]*\n|[^\n]+"}[unit]
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("ab é\n\t€ ") for _ in range(rng.randrange(50)))
        units = re.findall(pattern, text)
        assert "".join(units) == text
        tree = fill_middle.UnitTree(text.encode(), unit, block=5)
        assert tree.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_long_text():
    text = "aé€\U0001f600" * 500_000
    tree = fill_middle.UnitTree(text.encode())
    assert tree.cut(1_234_567) == (len(text[:1_234_567].encode()), 1_234_567)


def test_edges(spark, edges, clashing, nothing):
    got = fill_middle.fill_in_middle(edges)
    assert got.columns == [*edges.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = [(r["doc_id"], r["text"], r["lang"], tuple(r)[3:]) for r in got.collect()]
    want = [(d, t, lang, brute(d, t)) for d, t, lang in EDGES]
    assert sorted(rows, key=str) == sorted(want, key=str)
    clashed = clashing.withColumnsRenamed({"score": "n", "slot": "output", "_hits": "_c0"})
    again = fill_middle.fill_in_middle(clashed)
    assert [c for c in clashed.columns if c not in fill_middle.ADDED] == again.columns[:-5]
    assert again.select("n", "output").distinct().count() == len({w[3][0::4] for w in want})
    assert set(map(tuple, again.select("_c0", "size").distinct().collect())) == {("clash", "clash")}
    assert fill_middle.fill_in_middle(nothing).count() == 0


def test_marks_and_broken_marks_come_back(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<<P", "<P <S <M", "P>S>M>", "<" * 50, ">" * 50, "<P" * 20 + ">"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 30)], "doc_id long, text string")
    rows = fill_middle.fill_in_middle(docs).collect()
    assert all(r["text"] == texts[r["doc_id"] % len(texts)] for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert all(tuple(r)[2:] == brute(r["doc_id"], texts[r["doc_id"] % len(texts)]) for r in rows)


def test_word_units_restore(spark, documents):
    rows = fill_middle.fill_in_middle(documents, "word")
    assert rows.join(documents.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0


def test_query(spark, documents):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in documents.select("doc_id", "text").collect():
        *head, output = brute(r["doc_id"], r["text"])
        want[r["doc_id"]] = (*head, sha(output), sha(r["text"] or ""))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_fill_middle"](spark, DATA).collect()}
    assert got == want
