import random

import numpy as np
import pytest

from vigilframe.llm import decontaminate as D
from vigilframe.llm.common import QUERIES
from vigilframe.llm.words import word_hashes

from .conftest import DATA, EDGES


def words_of(text):
    return word_hashes([(text or "").lower().encode()], marks=True)[0].tolist()


def brute(item, text):
    """Least word edit distance of ``item`` to any part of ``text``."""
    a, b = words_of(item), words_of(text)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.choice("ids")
        words[at : at + (kind != "i")] = [] if kind == "d" else [f"zz{rng.randrange(10**9)}"]
    return words


ITEM = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree nearby"


def test_edges(spark, edges, clashing, nothing):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM.upper()), (3, ""), (4, None), (None, ITEM), (5, "too short")], "item_id long, text string")
    hit = spark.createDataFrame([(50, "start. " + ITEM.replace(" ", ",\n"), "en"), (51, ITEM[: len(ITEM) // 2], "en")], "doc_id long, text string, lang string")
    found = D.contaminations(edges.union(hit), bench).collect()
    assert sorted({(r["doc_id"], r["item_id"], r["start"], r["end"], r["distance"]) for r in found}) == [(50, 1, 1, 21, 0), (50, 2, 1, 21, 0)]
    assert D.drop_contaminated(edges.union(hit), bench).count() == len(EDGES) + 1
    assert D.drop_contaminated(clashing, bench).columns == clashing.columns
    assert D.contaminations(nothing, bench).count() == 0
    assert D.contaminations(edges, bench.limit(0)).count() == 0
    assert D.drop_contaminated(edges, bench.limit(0)).count() == len(EDGES)


def test_recall_and_exactness_against_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60)))) for i in range(40)]
    block = D.Items(items)
    texts, planted = [], []
    for n in range(200):
        around = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        item, text = rng.choice(items)
        words = edited(rng, text.split(), D.allowed(len(text.split())))
        at = rng.randint(0, len(around))
        texts.append(" ".join(around[:at] + words + around[at:]))
        planted.append((n, item))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(50)]
    found = {(t, i): d for t, item, _, _, d in block.find(*word_hashes([t.encode() for t in texts], marks=True)) for i in block.ids[item]}
    assert np.mean([p in found for p in planted]) >= 0.95
    for (t, i), distance in found.items():
        assert distance == brute(items[i][1], texts[t]) <= D.allowed(len(items[i][1].split()))


def test_an_item_is_found_once_across_parts():
    """The text has more windows than one part; a changed copy comes first, the plain ones last."""
    changed = ITEM.replace("seven", "eight")
    text = " ".join([changed] * 900 + [ITEM] * 900)
    found = list(D.Items([(1, ITEM)]).find(*word_hashes([text.encode()], marks=True)))
    words = len(words_of(ITEM))
    assert found == [(0, 0, 900 * words, 901 * words, 0)]


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_blocks_cover_all_items(spark, block_bytes):
    bench = spark.createDataFrame([(i, f"item number {i} of many items here") for i in range(30)], "item_id long, text string")
    blocks = list(D.item_blocks(bench, block_bytes))
    assert sorted(i for b in blocks for i, _ in b) == list(range(30))
    assert (len(blocks) > 1) == (block_bytes == 200)


def test_query_finds_verbatim_items(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in items if t in r["text"]}
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op3_decontamination"](spark, DATA).collect()}
    assert want and want <= set(found)
    assert all(found[p] == 0 for p in want)
