"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words. The CGK random walk copies a sequence into a
longer one, standing still or stepping on by a coin per (step, word) that all
sequences share; a small edit distance becomes a small Hamming distance. Each table
of the LSH samples some places of one embedding; a window of a text and an item that
agree on all places of a table are candidates, and the word edit distance of every
candidate is then computed exactly. The number of tables follows from the recall
asked for, measured on items with as many random edits as are still a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import keeps_columns, query, small_batches, table, text_groups
from vigilframe.llm.words import mix, word_hashes

SIMILARITY = 0.8
MIN_WORDS = 5
TARGET_RECALL = 0.95
SAMPLED = 4
TABLES_PER_WALK = 16
# Items travel to the workers in blocks of at most about this many bytes of text;
# a larger benchmark takes more passes over the documents.
BLOCK_BYTES = 4 << 20
# Texts are searched in groups of about this size; larger ones cost memory, smaller ones time.
GROUP_BYTES = 4 << 20
SEED = 11
# Fields of a hit; places are word numbers, end exclusive.
HIT = {"item_id": "long", "start": "int", "end": "int", "distance": "int", "words": "int"}


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    """Edits that leave an item of so many words similar enough."""
    return int((1 - similarity) * words + 1e-9)


def walk(windows: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embeddings, one column per window: the word read at each step."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), np.uint64(2**64 - 1))], 1)
    place, rows = np.zeros(n, np.int64), np.arange(n)
    flips = mix(np.arange(2 * steps, dtype=np.uint64) + np.uint64(seed << 32))
    out = np.empty((steps, n), np.uint64)
    for step in range(steps):
        out[step] = word = padded[rows, place]
        # Words are mixed hashes already: one multiplication gives a fresh coin per step.
        coin = ((word ^ flips[step]) * (flips[steps + step] | np.uint64(1))) >> np.uint64(63)
        place += coin.view(np.int64)
        np.minimum(place, width, out=place)
    return out


class _Class:
    """Items of about one length: they share the window width and the tables."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], target: float, similarity: float):
        self.width, self.items = width, items
        self.edits = max(allowed(len(words), similarity) for _, words in items)
        # The walk leaves a window after about two steps a word; later places say nothing.
        self.steps = 2 * width - width // 4
        self.places: dict[int, np.ndarray] = {}
        self.heads = np.stack([words[:width] for _, words in items])
        self.tables = self._enough(target, similarity)
        keys = self.keys(self.heads)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, 1)

    def _places(self, number: int) -> np.ndarray:
        """Places that a table samples."""
        if number not in self.places:
            random = np.random.default_rng([SEED, self.width, number])
            self.places[number] = random.choice(self.steps, min(SAMPLED, self.steps), replace=False)
        return self.places[number]

    def keys(self, windows: np.ndarray, tables: int | None = None) -> np.ndarray:
        """Hashes of the sampled places, one row per table."""
        tables = tables or self.tables
        out = np.empty((tables, len(windows)), np.uint64)
        for first in range(0, tables, TABLES_PER_WALK):
            seen = walk(windows, self.steps, first + 1)
            for t in range(first, min(first + TABLES_PER_WALK, tables)):
                key = np.full(len(windows), np.uint64(t))
                for place in self._places(t):
                    key = (key ^ seen[place]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                out[t] = key
        return out

    def _enough(self, target: float, similarity: float, trials: int = 256, probe: int = 64) -> int:
        """Tables needed so that an item with the most edits allowed is found with this probability."""
        random = np.random.default_rng([SEED, self.width])
        pick = random.integers(len(self.items), size=trials)
        edited = []
        for i in pick:
            words = list(self.items[i][1])
            for _ in range(allowed(len(words), similarity)):
                at, kind = random.integers(len(words)), random.integers(3)
                fresh = np.uint64(random.integers(1 << 63))
                words[at : at + (kind != 1)] = [] if kind == 2 else [fresh]
            words = words[: self.width]
            edited.append(words + [np.uint64(2**64 - 1)] * (self.width - len(words)))
        hit = self.keys(self.heads[pick], probe) == self.keys(np.array(edited, np.uint64), probe)
        miss, tables = 1.0, 0
        per_trial = np.clip(hit.mean(0), 1 / (2 * probe), 1 - 1e-9)
        while miss > 1 - target and tables < 1024:
            tables += 8
            miss = float(((1 - per_trial) ** tables).mean())
        return tables


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, target: float = TARGET_RECALL):
        hashes, counts = word_hashes([t.lower().encode() for _, t in items], marks=True)
        texts: dict[bytes, tuple[np.ndarray, list[int]]] = {}
        for (item, _), words in zip(items, np.split(hashes, np.cumsum(counts)[:-1]) if len(items) else []):
            if len(words) >= MIN_WORDS:
                texts.setdefault(words.tobytes(), (words, []))[1].append(item)
        self.similarity = similarity
        self.words = [w for w, _ in texts.values()]
        self.ids = [ids for _, ids in texts.values()]
        self.item_pairs = [set(_pairs(w).tolist()) for w in self.words]
        self.pairs = np.array(sorted(set().union(*self.item_pairs)), np.uint64)
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, w in enumerate(self.words):
            width = MIN_WORDS
            while (wider := max(width + 1, width * 5 // 4)) <= len(w):
                width = wider
            by_width.setdefault(width, []).append((i, w))
        self.classes = [_Class(width, members, target, similarity) for width, members in sorted(by_width.items())]

    def find(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, distance) of the best place of each item in each text."""
        if not len(hashes) or not self.words:
            return
        pairs = _pairs(hashes)
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        known = np.concatenate([[0], np.cumsum(self.pairs[at] == pairs), [0]])
        known[-1] = known[-2]
        # Of each word: its text, and where that text begins and ends.
        texts = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)[texts]
        begins = ends - counts[texts]
        for group in self.classes:
            # Each edit breaks two pairs of neighbours at most, so a match holds this many
            # pairs of its item; windows with fewer pairs of any item need no embedding.
            kept = group.width - 1 - 2 * group.edits
            start = np.arange(len(hashes))
            stop = np.minimum(start + group.width + group.edits, ends) - 1
            start = start[known[stop] - known[start] >= kept]
            # A text may go on in the next part: the best place is kept over all of them.
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for part in np.array_split(start, len(start) // 4096 + 1):
                for text, item, begin, end, distance in self._in_windows(group, part, hashes, pairs, texts, begins, ends):
                    place = (distance, begin, end)
                    best[text, item] = min(place, best.get((text, item), place))
            for (text, item), (distance, begin, end) in best.items():
                yield text, item, begin, end, distance

    def _in_windows(self, group, start, hashes, pairs_here, texts, begins, ends):
        if not len(start):
            return
        inside = start[:, None] + np.arange(group.width)
        windows = hashes[np.minimum(inside, len(hashes) - 1)]
        windows[inside >= ends[start][:, None]] = np.uint64(2**64 - 1)
        pairs = set()
        for keys, known, order in zip(group.keys(windows), group.sorted, group.order):
            low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
            for row in np.flatnonzero(high > low):
                pairs.update((int(start[row]), int(order[x])) for x in range(low[row], high[row]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[int, int] = {}
        for first, member in sorted(pairs, key=lambda p: (p[1], p[0])):
            item, words = group.items[member]
            if done.get(member, -1) > first:  # this window was inside the stretch compared before
                continue
            text, k = int(texts[first]), allowed(len(words), self.similarity)
            begin = max(int(begins[first]), first - k)
            end = min(int(ends[first]), first + 2 * len(words) + k)
            done[member] = min(first + len(words) // 2, end)
            own = sum(map(self.item_pairs[item].__contains__, pairs_here[begin : end - 1].tolist()))
            if own < len(words) - 1 - 2 * k:
                continue  # too few pairs of this item: more edits than allowed
            found = _best_place(words, hashes[begin:end])
            if found[0] <= k:
                place = (found[0], begin + found[1], begin + found[2])
                best[text, item] = min(place, best.get((text, item), place))
        for (text, item), (distance, begin, end) in best.items():
            offset = int(begins[begin])
            yield text, item, begin - offset, end - offset, distance


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1]) + hashes[1:]


def _best_place(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the part of ``stretch`` closest to ``item``; the first one if tied."""
    steps = np.arange(len(stretch) + 1)
    cost, origin = np.zeros(len(steps), np.int64), steps.copy()
    big = len(steps) + 1
    for word in item:
        # Cost and origin share one number, so that equal costs keep the later start.
        previous = cost * big + (big - 1 - origin)
        change = previous[:-1] + np.where(stretch == word, 0, big)
        row = previous + big
        row[1:] = np.minimum(row[1:], change)
        row = np.minimum.accumulate(row - steps * big) + steps * big
        cost, origin = row // big, big - 1 - row % big
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) in blocks of bounded size; NULL ids and texts are left out."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]


def with_hits(docs: DataFrame, items: Items) -> DataFrame:
    """``docs`` with ``_hits``: the items found in each whole text, with word places and distance.

    One row per input row; NULL and empty texts have none. Equal items are reported
    under each of their ids, items of fewer than five words not at all.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("_hits")
    shared = docs.sparkSession.sparkContext.broadcast(items)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def find(batches):
        block = shared.value
        for batch in batches:
            hits: list[list[dict]] = [[] for _ in range(len(batch))]
            texts = [t or "" for t in batch["text"]]
            for first, group in text_groups([t.lower().encode() for t in texts], GROUP_BYTES):
                for text, item, start, end, distance in block.find(*word_hashes(group, marks=True)):
                    rest = (start, end, distance, len(block.words[item]))
                    hits[first + text] += [dict(zip(HIT, (i, *rest))) for i in block.ids[item]]
            ordered = [sorted(h, key=lambda x: x["item_id"]) for h in hits]
            yield batch.assign(_hits=pd.Series(ordered, dtype=object, index=batch.index))

    return docs.mapInPandas(find, f"{fields}, _hits array<struct<{', '.join(f'{k}:{v}' for k, v in HIT.items())}>>")


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row and item found: doc_id, item_id, start, end (words), distance, similarity."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = None
    for block in item_blocks(benchmark):
        rows = (
            with_hits(docs, Items(block, similarity))
            .select("doc_id", F.explode("_hits").alias("h"))
            .select("doc_id", "h.*", (1 - F.col("h.distance") / F.col("h.words")).alias("similarity"))
            .drop("words")
        )
        found = rows if found is None else found.union(rows)
    if found is None:
        names = ", ".join(f"{k} {v}" for k, v in HIT.items() if k != "words")
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, {names}, similarity double")
    return found


@keeps_columns("doc_id", "text")
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    for block in item_blocks(benchmark):
        docs = with_hits(docs, Items(block, similarity)).where(F.size("_hits") == 0).drop("_hits")
    return docs


@query("op3_decontamination")
def op3_decontamination(spark, folder):
    """Benchmark items found in each document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contaminations(docs, table(spark, folder, "benchmark").select("item_id", "text"))
