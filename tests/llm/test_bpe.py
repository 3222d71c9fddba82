import hashlib
import os

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigilframe.llm import bpe
from vigilframe.llm.common import QUERIES

from .conftest import DATA, EDGES

PATH = bpe.vocabulary_path()
TOKENIZER = Tokenizer.from_file(PATH)


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "́", " ", "\n", "\x1c", " ", "'s", "<|endoftext|>", "1", "漢", "😀", "!", "J", "I", "̌", "̇", ".", ","]), max_size=60))
def test_small_texts(parts):
    text = "".join(parts)
    assert next(bpe.Encoder(PATH).encode([text.encode()])).tolist() == plain(text)


def test_cut_joins_are_repaired(monkeypatch):
    """Chunks far shorter than words, so that nearly every join needs repair."""
    monkeypatch.setattr(bpe, "MIN_CHUNK", 1)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 1)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh  é!1\n") for _ in range(n)) for n in (40, 200, 1000)] + ["x" * 3000]
    cut = bpe.cuts
    monkeypatch.setattr(bpe, "cuts", lambda data: cut(data, 1))
    encoder = bpe.Encoder(PATH)
    assert len(bpe.cuts(texts[2].encode())) > 100
    assert [i.tolist() for i in encoder.encode([t.encode() for t in texts])] == [plain(t) for t in texts]


def test_shared_passages_give_shared_chunks():
    rng = random.Random(2)
    passage = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.random()) for _ in range(2000)).encode()
    chunks = []
    for before in (b"one start ", b"quite another start of a text "):
        data = before + passage
        ends = bpe.cuts(data)
        chunks.append({data[a:b] for a, b in zip([0, *ends], ends)})
    assert len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0])


def test_stores_stay_small(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_STORE", 4000)
    monkeypatch.setattr(bpe, "WORD_STORE", 50)
    encoder = bpe.Encoder(PATH)
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(5)]
    assert [i.tolist() for i in encoder.encode([t.encode() for t in texts])] == [plain(t) for t in texts]
    assert encoder.held <= 4000


def test_edges(edges, clashing, nothing):
    for docs in (edges, clashing):
        got = bpe.encode_decode(docs).collect()
        assert len(got) == len(EDGES)
        by_text = {(d, tuple(plain(t))) for d, t, _ in EDGES}
        assert {(r["doc_id"], tuple(r["ids"])) for r in got} == by_text
    assert bpe.encode_decode(nothing).count() == 0


def test_query(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, DATA).collect()}
    for r in documents.collect():
        ids, got = plain(r["text"]), found[r["doc_id"]]
        decoded = TOKENIZER.decode(ids, skip_special_tokens=False)
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
