import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import prefix_trie
from vigilframe.llm.common import QUERIES

from .conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16]


def brute(rows, rebuild=True):
    """Nodes by walking whole prefixes in Python."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    whole = dict(own)
    if rebuild:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 9
            base = c - int(np.fmod(c, 5))
            whole[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    children, leaves, saved, ends = {}, {}, {}, {}
    for path, members in nodes.items():
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        gain = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] = saved.get(path[:d], 0) + gain
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
    for path, members in nodes.items():
        last = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            children.get(path, 0), leaves[path], saved[path], hashlib.sha256(last.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rebuilt_nodes(conversations):
    turns = prefix_trie.turn_digests(conversations)
    return prefix_trie.trie_nodes(prefix_trie.prefix_rows(turns, prefix_trie.borrowed_beginnings(turns)))


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, convs=120, turns=12):
    """Few distinct turns, so that prefixes, whole conversations and ends are shared."""
    rng = random.Random(seed)
    rows = []
    for c in range(-7, convs):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, turns])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "user", "é" * rng.choice([0, 1, 1, 1, 2])))
    return rows


@pytest.mark.parametrize("cells", [None, 128])
@pytest.mark.parametrize("rebuild", [True, False])
def test_against_whole_prefixes(spark, rebuild, cells, monkeypatch):
    if cells:  # a sketch so full that it proves next to nothing
        monkeypatch.setattr(prefix_trie, "_cell_count", lambda n: cells)
    rows = made(3)
    random.Random(1).shuffle(rows)
    data = spark.createDataFrame(rows, SCHEMA)
    got = rebuilt_nodes(data) if rebuild else prefix_trie.prefix_trie(data)
    assert found(got) == brute(rows, rebuild)


def test_edges(spark):
    rows = [
        (1, None, None, None), (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"),
        (None, 0, "user", "a"), (2, 0, "", ""), (2, 1, None, "x" * 200_000), (3, 5, "user", "a"), (10**15, 0, "us", "era"),
        (-3, 0, "user", "a"), (0, 0, "", None), (11, 0, "u", "sera"), (14, 0, "", ""),
    ]
    data = spark.createDataFrame(rows, SCHEMA)
    assert found(rebuilt_nodes(data)) == brute(rows)
    assert found(prefix_trie.prefix_trie(data)) == brute(rows, rebuild=False)
    clash = {n: F.lit("clash") for n in ("depth", "x1", "n", "m", "h", "place", "_part", "_tie", "kind", "rep", "token")}
    assert found(rebuilt_nodes(data.withColumns(clash))) == brute(rows)
    assert rebuilt_nodes(data.limit(0)).count() == 0
    assert found(rebuilt_nodes(data.where("conv_id = 2"))) == brute([r for r in rows if r[0] == 2])


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (5, 10, 11) for t in range(700 if c < 11 else 3)]
    data = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_trie.prefix_trie(data)) == brute(rows, rebuild=False)


def test_screen_never_hides_a_shared_prefix(spark):
    x = np.random.default_rng(1).integers(-(2**63), 2**63, (3000, 2))
    x = np.concatenate([x, x[:1000]])
    rows = spark.createDataFrame(x.tolist(), "x1 long, x2 long").repartition(7)
    maybe = prefix_trie.build_sketch(rows).may_be_shared(x[:, 0].copy(), x[:, 1].copy())
    assert maybe[:1000].all() and maybe[3000:].all()
    assert maybe[1000:3000].mean() < 0.1


def test_ids_of_one_node_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 100)
    ids = [*range(-300, 3000, 7)]
    data = spark.createDataFrame([(2, 5, 6, i) for i in ids] + [(2, 5, 7, 1)], "depth int, x1 long, x2 long, conv_id long")
    got = {r["x2"]: r["ends_sha256"] for r in prefix_trie.list_digests(data.repartition(6)).collect()}
    assert got == {6: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 7: hashlib.sha256(b"1").hexdigest()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, DATA)) == brute(rows)
