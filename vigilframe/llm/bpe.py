"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over sixteen bytes decides where a text is cut, so a passage that
several documents share gives the same chunks in all of them, wherever it stands. A
worker encodes a chunk once and keeps its ids. Cuts ignore words; where one falls
inside a word, the join is repaired: the words around it are encoded anew, in a
window that widens until the ids to its left and right agree exactly with what the
chunks gave.
"""

from __future__ import annotations

import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import query, small_batches, table

VOCABULARY = "word_bpe_49k.json"
CHUNK_BITS = 10
MIN_CHUNK = 64
# A worker keeps ids of this many bytes of chunks, oldest out first, and of the words of
# two generations of this size. What was dropped is encoded again when it is met again.
CHUNK_STORE = 24 << 20
WORD_STORE = 1_000_000
# The white space that bytes.split() knows; no token spans it.
SPACE = b" \t\n\r\x0b\x0c"

# Punctuation that, ending a word after an ASCII letter or digit, is encoded by itself.
ENDING = b".,!?;:"
# Bytes that forbid lower-casing ahead: special tokens keep their case, and a letter
# may compose with a combining mark (lead bytes 0xCC and 0xCD) in one case only.
_CASED = re.compile(rb"[<\xcc\xcd]")
# Words of Latin letters alone or of ending punctuation alone: one run of tokens each.
_ONE_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[.,!?;:]+")
# Words encoded in one call of the library.
CALL_WORDS = 512
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ENCODERS: dict[str, Encoder] = {}


def cuts(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of all chunks of a text; every cut stands between two characters."""
    n = len(data)
    if n < 32:
        return [n] if n else []
    words = np.ndarray((n - 7,), "<u8", data, 0, (1,))
    rolled = (words[:-8] * _A) ^ (words[8:] * _B)
    rolled *= _A
    hit = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + 16  # the cut follows the window
    ends, last = [], 0
    for at in hit.tolist():
        if at - last >= MIN_CHUNK and at < n and data[at] & 0xC0 != 0x80:
            ends.append(at)
            last = at
    return [*ends, n]


def split(data: bytes) -> list[bytes]:
    """Words, which are encoded independently of each other."""
    return (data if _CASED.search(data) else data.lower()).split()


class Encoder:
    """Ids of texts as the tokenizers library gives them, one per worker and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = None
        if self.tokenizer.decoder is None:
            # Without a decoder, a text decodes to its tokens with blanks between them.
            self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        # Ids that end a run of letters or signs, in vocabularies that mark it.
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.ends = np.array([n.endswith("</w>") for n in names], bool)
        # Ids of a word as packed 32-bit integers, so those of many words are joined in one step.
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.held = 0

    def _learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.words]
        if fresh and len(self.words) + len(fresh) > WORD_STORE:
            self.older, self.words, fresh = self.words, {}, list(words)
        self.words.update((w, self.older[w]) for w in fresh if w in self.older)
        fresh = [w for w in fresh if w not in self.words]
        # A word and the punctuation that ends it are encoded apart: fewer words are new.
        ended = []
        for w in fresh:
            stem = w.rstrip(ENDING)
            if len(stem) < len(w) and stem and stem[-1:].isalnum():
                ended.append((w, stem, w[len(stem) :]))
        if ended:
            whole = {w for w, _, _ in ended}
            new = {p for _, *parts in ended for p in parts if p not in self.words}
            fresh = [w for w in {*fresh, *new} if w not in whole]
        self._encode(fresh)
        self.words.update((w, self.words[a] + self.words[b]) for w, a, b in ended)

    def _encode(self, fresh: list[bytes]) -> None:
        """Ids of words, by the library."""
        simple, rest = [], fresh
        if self.ends.any():
            rest, match = [], _ONE_RUN.fullmatch
            for w in fresh:
                (simple if match(w) else rest).append(w)
        # Words of one run are encoded many at a time; the ids that end a run part them again.
        parts = [simple[i : i + CALL_WORDS] for i in range(0, len(simple), CALL_WORDS)]
        found = self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)
        for part, encoding in zip(parts, found):
            ids = np.array(encoding.ids, np.uint32)
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(part):
                packed = ids.tobytes()
                self.words.update((w, packed[a:b]) for w, a, b in zip(part, [0, *stops], stops))
            else:
                rest = rest + part
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.words.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(rest, found))

    def piece(self, data: bytes) -> list[int]:
        """Ids of a stretch of text; ASCII white space separates words and has no tokens."""
        return self._ids(split(data)).tolist()

    def _ids(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32)
        except KeyError:
            self._learn(set(words))
            return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32)

    def _store(self, chunk: bytes, words: list[bytes]) -> np.ndarray:
        ids = self._ids(words)
        self.chunks[chunk] = ids
        self.held += len(chunk) + ids.nbytes
        while self.held > CHUNK_STORE:
            old, gone = self.chunks.popitem(last=False)
            self.held -= len(old) + gone.nbytes
        return ids

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        ends = [cuts(t) for t in texts]
        parts = [[t[a:b] for a, b in zip([0, *e], e)] for t, e in zip(texts, ends)]
        fresh = {c: split(c) for c in {c for p in parts for c in p if c not in self.chunks}}
        self._learn(set(chain.from_iterable(fresh.values())))
        for text, chunks, stops in zip(texts, parts, ends):
            out, begin = [], 0
            for chunk, stop in zip(chunks, stops):
                ids = self.chunks.get(chunk)
                if ids is None:
                    # A chunk that was held may have been dropped meanwhile.
                    ids = self._store(chunk, fresh.get(chunk) or split(chunk))
                else:
                    self.chunks.move_to_end(chunk)
                self._join(text, out, ids, begin, stop)
                begin = stop
            yield np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids, as the library's ``decode`` gives them, special tokens included."""
        if self.tokens is None:
            return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
        return [" ".join(map(self.tokens.__getitem__, i.tolist())) for i in ids]

    def _join(self, text: bytes, out: list[np.ndarray], ids: np.ndarray, at: int, stop: int) -> None:
        """Append a chunk's ids to those of the text before ``at``, repairing the join."""
        if at == 0 or text[at - 1] in SPACE or text[at] in SPACE:
            out.append(ids)
            return
        left = max(text.rfind(bytes([s]), 0, at) for s in SPACE) + 1
        right = min((p for s in SPACE if (p := text.find(bytes([s]), at, stop)) >= 0), default=stop)
        while True:
            before, after = self.piece(text[left:at]), self.piece(text[at:right])
            done = _take(out, len(before))
            if done.tolist() == before and ids[: len(after)].tolist() == after:
                out.append(np.array(self.piece(text[left:right]), np.uint32))
                out.append(ids[len(after) :])
                return
            out.append(done)
            if left == 0 and right == stop:
                out[:] = [np.array(self.piece(text[:stop]), np.uint32)]
                return
            left = max((text.rfind(bytes([s]), 0, max(left - 1, 0)) for s in SPACE), default=-1) + 1
            right = min((p for s in SPACE if (p := text.find(bytes([s]), right + 1, stop)) >= 0), default=stop)


def _take(out: list[np.ndarray], count: int) -> np.ndarray:
    """Remove the last ``count`` ids (or all, if fewer) from a list of arrays."""
    taken = []
    while count > 0 and out:
        last = out.pop()
        if len(last) > count:
            out.append(last[:-count])
            last = last[-count:]
        taken.append(last)
        count -= len(last)
    return np.concatenate(taken[::-1]) if taken else np.zeros(0, np.uint32)


def _encoder(path: str) -> Encoder:
    """The worker's encoder: it lives as long as the worker and serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``ids`` (array of int) of every whole text and ``decoded``, the text they stand for.

    Keeps the columns ``keep`` (default: doc_id). NULL texts count as empty: no ids, empty
    text. Rows are independent of each other, so repeated ones give equal rows.
    """
    small_batches(docs.sparkSession)
    path, keep = path or vocabulary_path(), keep or ["doc_id"]
    rows = docs.select(*keep, F.col("text").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.pop("_text")]
            ids = list(encoder.encode(texts))
            decoded = encoder.decode(ids)
            held = pd.Series([i.astype(np.int32) for i in ids], dtype=object, index=batch.index)
            yield batch.assign(ids=held, decoded=pd.Series(decoded, dtype=object, index=batch.index))

    return rows.mapInPandas(run, f"{fields}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with the number and SHA-256 of the ids, and the SHA-256 of the decoded text."""
    return encode_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_bpe")
def op10_bpe(spark, folder):
    """Ids and decoded text of every document, as digests."""
    return digests(table(spark, folder, "documents"))
