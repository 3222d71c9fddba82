"""Interpolated modified Kneser-Ney bigram model over whole corpora.

Spark counts words and word pairs; tasks merge their counts into sorted arrays of
64-bit hashes in the shared folder. Workers map these files into memory and look
words and pairs up by binary search, so a worker needs pages it touches, not the model.

A text is its words and one end mark; each word is scored given the one before it
(the first given a start mark):

    p(w | u) = (c(u w) - D(c(u w))) / c(u) + gamma(u) * p(w)
    p(w) = (n(w) - D'(n(w))) / n + gamma' / (V + 1)

with c counts, n(w) the number of different words seen before w, n all pairs, V the
distinct words and D, D' discounts for one, two, three and more, from counts of counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import id_bucket, new_table_path, open_store, query, small_batches, table, text_groups
from vigilframe.llm.words import mix, word_hashes

# A file of the model holds about this many entries.
FILE_ROWS = 1 << 19
# Counts of a task are merged and sent on whenever this many tokens are held.
HELD_TOKENS = 2 << 20
END = np.uint64(0x5BD1E9955BD1E995)
START = np.uint64(0xA5A5A5A5DEADBEEF)
# Fields of one word in the model besides its hash.
WORD = np.dtype([("count", "<u8"), ("before", "<u4"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4")])
PAIRS = "bucket long, firsts binary, fans binary, seconds binary, counts binary"
STATS = "bucket long, words binary, stats binary, kinds array<long>"
# Pairs of one first word are spread over this many files.
SPREAD = 16
_OPEN: dict[str, Model] = {}


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (words, then one end per text), the token before each, and tokens per text."""
    words, counts = word_hashes(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(len(words) + len(counts), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[~is_end], tokens[is_end] = words, END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - sizes + 1] = START
    return tokens, before, sizes


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _file_of_word(words: np.ndarray, files: int) -> np.ndarray:
    """Equal slices of the hash range, in order."""
    return (((words >> np.uint64(32)) * np.uint64(files)) >> np.uint64(32)).astype(np.int64)


def _file_of_pair(before: np.ndarray, tokens: np.ndarray, files: int) -> np.ndarray:
    """Pairs of a first word stay together but for a spread by the second one."""
    shift = (tokens % np.uint64(SPREAD)).astype(np.int64) * files // SPREAD
    return (_file_of_word(before, files) + shift) % files


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(changed)


def _pieces(first: np.ndarray, *columns: np.ndarray) -> list[list[bytes]]:
    """Each column cut at ``first``, as bytes."""
    stops = np.append(first[1:], len(columns[0]))
    return [[c[a:b].tobytes() for a, b in zip(first, stops)] for c in columns]


def _pairs_counted(batches, files: int):
    """Distinct pairs of a task with counts, one row per file: each first word once, with its followers."""
    held, size = [], 0

    def flush():
        before, tokens = (np.concatenate(x) for x in zip(*held))
        _, at, n = np.unique(pair_hash(before, tokens), return_index=True, return_counts=True)
        before, tokens, n = before[at], tokens[at], n.astype(np.uint32)
        number = _file_of_pair(before, tokens, files)
        order = np.lexsort((before, number))
        before, tokens, n, number = before[order], tokens[order], n[order], number[order]
        fan = _starts(number, before)
        fans = np.diff(np.append(fan, len(before))).astype(np.uint32)
        by_fan, by_pair = _starts(number[fan]), _starts(number)
        firsts, fans = _pieces(by_fan, before[fan], fans)
        seconds, counts = _pieces(by_pair, tokens, n)
        return pd.DataFrame(
            {"bucket": number[by_pair], "firsts": firsts, "fans": fans, "seconds": seconds, "counts": counts}
        )

    for batch in batches:
        for _, group in text_groups([(t or "").encode() for t in batch["text"]]):
            tokens, before, _ = sequences(group)
            held.append((before, tokens))
            size += len(tokens)
            if size > HELD_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays to ``folder``; a task that runs again puts the same file there."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    store.move(draft, f"{path}/{name}")


def train(docs: DataFrame, file_rows: int = FILE_ROWS) -> str:
    """Model of all rows of ``docs``, written to the shared folder; returns the folder.

    NULL texts count as empty (one end mark). Pairs are dealt by their hash, so the pairs
    of a word that starts a third of them are spread over all files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_table_path(spark, "model")
    texts = docs.select("text")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # A token takes six bytes of text or so; files are sized by that.
    files = max(1, -(-(size["n"] + (size["bytes"] or 0) // 6) // (2 * file_rows)))
    counted = texts.mapInPandas(lambda batches: _pairs_counted(batches, files), PAIRS)

    def merge_pairs(batches):
        """Write the pairs of each file; send on what they add to the words' statistics."""
        for bucket, rows in _by_bucket(batches):
            before = np.repeat(_joined(rows["firsts"], np.uint64), _joined(rows["fans"], np.uint32))
            tokens, n = _joined(rows["seconds"], np.uint64), _joined(rows["counts"], np.uint32).astype(np.int64)
            keys = pair_hash(before, tokens)
            order = np.argsort(keys)
            keys = keys[order]
            first = _starts(keys)
            n, order, keys = np.add.reduceat(n[order], first), order[first], keys[first]
            _save(folder, f"pairs-{bucket:06d}", keys, n.astype(np.uint32))
            stats = np.zeros((2 * len(keys), 5), np.uint32)
            stats[: len(keys), 0] = n
            stats[len(keys) :, 1] = 1
            for i in (1, 2, 3):
                stats[: len(keys), i + 1] = np.minimum(n, 3) == i
            words = np.concatenate([before[order], tokens[order]])
            order = np.argsort(words)
            words = words[order]
            first = _starts(words)
            stats, words = np.add.reduceat(stats[order], first, axis=0, dtype=np.uint32), words[first]
            number = _file_of_word(words, files)
            cut = _starts(number)
            kinds = np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()
            sent_words, sent_stats = _pieces(cut, words, stats)
            yield pd.DataFrame(
                {
                    "bucket": number[cut],
                    "words": sent_words,
                    "stats": sent_stats,
                    "kinds": [kinds] + [[0] * 4] * (len(cut) - 1),
                }
            )

    def merge_words(batches):
        """Write the words of each file; give the sums that discounts need."""
        for bucket, rows in _by_bucket(batches):
            words = _joined(rows["words"], np.uint64)
            stats = _joined(rows["stats"], np.uint32).reshape(-1, 5).astype(np.int64)
            order = np.argsort(words)
            words = words[order]
            first = _starts(words)
            stats, words = np.add.reduceat(stats[order], first, axis=0), words[first]
            fields = np.empty(len(words), WORD)
            for i, name in enumerate(WORD.names):
                fields[name] = stats[:, i]
            _save(folder, f"words-{bucket:06d}", words, fields)
            seen = stats[words != START, 1]
            yield pd.DataFrame(
                {
                    "vocabulary": [len(seen)],
                    "pairs": [int(seen.sum())],
                    "tokens": [int(stats[:, 0].sum())],
                    "word_kinds": [np.bincount(np.minimum(seen, 5), minlength=6)[1:5].tolist()],
                    "pair_kinds": [np.sum(rows["kinds"].tolist(), axis=0).tolist()],
                }
            )

    dealt = counted.repartition(files, "bucket").sortWithinPartitions("bucket")
    stats = dealt.mapInPandas(merge_pairs, STATS).repartition(files, "bucket").sortWithinPartitions("bucket")
    sums = stats.mapInPandas(
        merge_words, "vocabulary long, pairs long, tokens long, word_kinds array<long>, pair_kinds array<long>"
    )
    whole = ["vocabulary", "pairs", "tokens"]
    parts = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("word_kinds", "pair_kinds") for i in range(4)]
    row = sums.agg(*[F.sum(c).alias(c) for c in whole], *parts).first().asDict()
    facts = {c: row[c] or 0 for c in whole} | {"files": files}
    facts |= {k: [row[f"{k}{i}"] or 0 for i in range(4)] for k in ("word_kinds", "pair_kinds")}
    _save(folder, "facts.json", np.frombuffer(json.dumps(facts).encode(), np.uint8))
    return folder


def _by_bucket(batches):
    """(bucket, rows) from batches sorted by bucket; a bucket may run over several batches."""
    held, number = [], None
    for batch in batches:
        for bucket, rows in batch.groupby("bucket", sort=True):
            if bucket != number and held:
                yield int(number), pd.concat(held, ignore_index=True)
                held = []
            number = bucket
            held.append(rows)
    if held:
        yield int(number), pd.concat(held, ignore_index=True)


def _discounts(kinds: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from counts of counts 1 to 4."""
    n1, n2, n3, n4 = kinds
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *(min(max(d, 0.01), i + 1 - 0.01) for i, d in enumerate(raw))]


class Model:
    """A trained model in a worker: files are mapped when they are first needed."""

    def __init__(self, folder: str):
        self.store, self.path = open_store(folder)
        with self.store.open_input_stream(f"{self.path}/facts.json") as facts:
            self.facts = json.loads(facts.read())
        self.files = self.facts["files"]
        self.maps: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.pair_discounts = np.array(_discounts(self.facts["pair_kinds"]))
        self.word_discounts = np.array(_discounts(self.facts["word_kinds"]))
        n1, n2 = self.facts["word_kinds"][:2]
        left = float(np.dot(self.word_discounts[1:], [n1, n2, self.facts["vocabulary"] - n1 - n2]))
        self.unseen = (left / self.facts["pairs"] if self.facts["pairs"] else 1.0) / (self.facts["vocabulary"] + 1)

    def _map(self, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and their values; an absent file has none."""
        if name not in self.maps:
            path = f"{self.path}/{name}"
            info = self.store.get_file_info(path)
            if info.type == pyarrow.fs.FileType.NotFound:
                self.maps[name] = np.zeros(0, np.uint64), np.zeros(0, kind)
            else:
                rows = info.size // (8 + np.dtype(kind).itemsize)
                data = self._mapped(path)
                self.maps[name] = data[: 8 * rows].view(np.uint64), data[8 * rows :].view(kind)
        return self.maps[name]

    def _mapped(self, path: str) -> np.ndarray:
        if isinstance(self.store, pyarrow.fs.LocalFileSystem):
            return np.memmap(path, np.uint8, "r")
        # A file of a remote store is copied once; the name goes at once, the mapping stays.
        with tempfile.NamedTemporaryFile() as copy, self.store.open_input_stream(path, compression=None) as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.memmap(copy.name, np.uint8, "r")

    def _look_up(self, name: str, kind, keys: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Values of ``keys``, zero where absent; searched in order, so neighbours share pages."""
        out = np.zeros(len(keys), kind)
        order = np.lexsort((keys, files))
        first = _starts(files[order])
        for a, b in zip(first, np.append(first[1:], len(keys))):
            rows = order[a:b]
            held, values = self._map(f"{name}-{files[rows[0]]:06d}", kind)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
                hit = held[at] == keys[rows]
                out[rows[hit]] = values[at[hit]]
        return out

    def words(self, words: np.ndarray) -> np.ndarray:
        return self._look_up("words", WORD, words, _file_of_word(words, self.files))

    def score(self, texts: list[bytes]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        tokens, before, sizes = sequences(texts)
        starts = np.cumsum(sizes) - sizes
        distinct, where = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
        stats = self.words(distinct)
        start = where[-1]
        word = where[:-1]
        # The word before: the previous token, or the start mark at the first one.
        prior = np.empty_like(word)
        prior[1:] = word[:-1]
        prior[starts] = start
        total, vocabulary = self.facts["tokens"], self.facts["vocabulary"]
        count = stats["count"].astype(np.float64)
        # Each text has one end, as each has one start mark before its first token.
        count_as_token = count.copy()
        count_as_token[distinct == END] = count[start]
        base = np.log10((count_as_token + 0.1) / (total + 0.1 * (vocabulary + 1)))[word]
        seen = stats["before"].astype(np.float64)
        lower = self.unseen + np.maximum(
            seen - self.word_discounts[np.minimum(stats["before"], 3).astype(np.int64)], 0
        ) / max(self.facts["pairs"], 1)
        gamma = sum(stats[f] * d for f, d in zip(("one", "two", "more"), self.pair_discounts[1:]))
        keys, at, back = np.unique(pair_hash(before, tokens), return_index=True, return_inverse=True)
        found = self._look_up("pairs", np.dtype(np.uint32), keys, _file_of_pair(before[at], tokens[at], self.files))
        n = found[back].astype(np.float64)
        cut = self.pair_discounts[np.minimum(found, 3).astype(np.int64)][back]
        history = count[prior]
        known = history > 0
        whole = np.where(known, history, 1.0)
        chance = np.where(known, (n - cut) / whole + gamma[prior] / whole * lower[word], lower[word])
        return pd.DataFrame(
            {
                "n_tokens": sizes,
                "n_known": np.add.reduceat((count_as_token[word] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(np.log10(chance), starts),
            }
        )


def with_scores(docs: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every whole text, with the columns ``keep``.

    ``score`` is the model's log10 probability; the perplexity of a text is
    10 ** (-score / n_tokens). NULL texts count as empty and score their end mark.
    """
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def score(batches):
        if folder not in _OPEN:
            _OPEN.clear()
            _OPEN[folder] = Model(folder)
        model = _OPEN[folder]
        for batch in batches:
            texts = [(t or "").encode() for t in batch.pop("_text")]
            found = [model.score(group) for _, group in text_groups(texts)]
            if found:
                scores = pd.concat(found, ignore_index=True).assign(train_tokens=model.facts["tokens"])
                yield pd.concat([batch.reset_index(drop=True), scores], axis=1)

    schema = f"{fields}, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(score, schema)


@query("op5_language_model")
def op5_language_model(spark, folder):
    """Scores of every document under a model of those outside the held-out tenth."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", id_bucket("doc_id", 10) == 0)
    scored = with_scores(docs, train(docs.where("not held_out")), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
