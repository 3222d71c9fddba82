"""Language identification by partial matching (PPM).

Every language has a context tree of bytes of order 0 to 3. A byte costs its code
length in the longest context that the tree holds; an unseen byte pays the escape of
that context (method C: distinct followers / (total + distinct followers)) and is
coded in the next shorter one, at last uniformly over 256 bytes. Statistics are
frozen after training, so the cost of a byte depends on the three bytes before it
alone: every distinct four-gram of a text is looked up once, and a text's exact code
length under all languages is a sum over its four-grams. The trees hold every path of the
training texts, as sorted arrays: about 16 bytes per path on the driver and each worker.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import id_bucket, keeps_columns, query, small_batches, table, text_groups

ORDER = 3
UNKNOWN = "und"
# Of this many parts of the texts, by their hash, one is kept out of the trees of ``accepted``
# and shows what clean texts cost.
PARTS = 10
# A text is like no language if it costs this many times the upper spread of its language
# (median to third quartile, LEAST_SPREAD bits a byte at least) over the median, and beyond
# that EVIDENCE bits as a whole, so that a few odd bytes never decide.
SPREADS, LEAST_SPREAD, EVIDENCE = 8, 0.5, 64
# Languages with fewer texts kept out share the limit of all texts; where all are fewer, nothing
# is known about clean texts and none is judged by its cost.
LEAST_TEXTS = 5
# Runs of printable ASCII that hold a digit: keys, numbers, addresses.
_CODES = re.compile(r"(?<![!-~])(?=[!-/:-~]*+[0-9])[!-~]++")
_NO_LETTERS = re.compile(r"[\W\d_]++")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-grams ending at each byte (three zero bytes stand before a text), and lengths."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    padded = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(texts), np.uint8).astype(np.uint32)
    grams = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    ends = np.cumsum(lengths + 3)
    keep = np.ones(len(grams), bool)
    for gap in range(3):  # four-grams that end in the padding between two texts
        keep[ends[:-1] - 3 + gap] = False
    return grams[keep], lengths


def letters(text: str) -> str:
    """Lower-case words of ``text`` without marks and without words that hold a digit.

    A text of nothing else stays as it is, in lower case.
    """
    left = _NO_LETTERS.sub(" ", _CODES.sub(" ", text)).strip()
    return (left or text).lower()


def _counted(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct four-grams, their counts, and the least and largest checksum of the texts that hold them."""
    grams, lengths = _grams(texts)
    sums = np.fromiter((zlib.crc32(t) for t in texts), np.uint64, len(texts))
    # One sort orders four-grams and, within each, the texts.
    keyed = np.sort((grams.astype(np.uint64) << np.uint64(32)) | np.repeat(sums, lengths))
    grams = keyed >> np.uint64(32)
    first = np.flatnonzero(np.diff(grams, prepend=np.uint64(2**63)))
    last = np.append(first[1:], len(keyed)) - 1
    text = keyed & np.uint64(2**32 - 1)
    return grams[first].astype(np.int64), last - first + 1, text[first].astype(np.int64), text[last].astype(np.int64)


def count_paths(docs: DataFrame, plain: bool = False) -> DataFrame:
    """Four-gram counts per language over all texts; each task sums before the shuffle.

    ``plain`` counts the letters of texts and leaves out what only one text holds, however
    often that text is there (texts are told apart by their CRC-32).
    """

    def count(batches):
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for _, group in text_groups([(letters(t) if plain else t).encode() for t in part["text"]], 4 << 20):
                    gram, n, low, high = _counted(group)
                    yield pd.DataFrame({"lang": lang, "gram": gram, "n": n, "low": low, "high": high})

    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    counted = rows.mapInPandas(count, "lang string, gram long, n long, low long, high long")
    sums = [F.sum("n").alias("n")]
    if not plain:
        return counted.groupBy("lang", "gram").agg(*sums)
    sums += [F.min("low").alias("low"), F.max("high").alias("high")]
    return counted.groupBy("lang", "gram").agg(*sums).where("low < high").drop("low", "high")


class _Tree:
    """Context tree of one language: sorted paths and contexts per order, with their bits."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            mask = (1 << 8 * (order + 1)) - 1
            path, where = np.unique(gram & mask, return_inverse=True)
            counts = np.bincount(where, n)
            context, where = np.unique(path >> 8, return_inverse=True)
            kinds = np.bincount(where)
            whole = np.log2(np.bincount(where, counts) + kinds)
            self.levels.append((
                mask, path.astype(np.uint32), (whole[where] - np.log2(counts)).astype(np.float32),
                context.astype(np.uint32), (whole - np.log2(kinds)).astype(np.float32),
            ))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-gram."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for mask, path, coded, context, escape in self.levels:
            key = gram[left] & np.uint32(mask)
            at, held = _look_up(path, key)
            out[left[held]] += coded[at[held]]
            left, key = left[~held], key[~held]
            # An unseen byte pays the escape of a context that is held, none of one that is not.
            at, held = _look_up(context, key >> np.uint32(8))
            out[left[held]] += escape[at[held]]
        out[left] += 8
        return out


def _look_up(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array that is not empty, and whether they are there."""
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return at, known[at] == key


class ContextTrees:
    """Frozen trees of all languages."""

    def __init__(self, langs: list[str], paths: pd.DataFrame):
        self.langs = langs
        gram, n = paths["gram"].to_numpy(np.int64), paths["n"].to_numpy(np.float64)
        self.trees = []
        for lang in langs:
            own = (paths["lang"] == lang).to_numpy()
            self.trees.append(_Tree(gram[own], n[own]))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, group in text_groups(texts):
            grams, lengths = _grams(group)
            known, where = np.unique(grams, return_inverse=True)
            ends = np.cumsum(lengths)
            for k, tree in enumerate(self.trees):
                cost = np.append(0, np.cumsum(tree.bits(known)[where]))
                out[first : first + len(group), k] = cost[ends] - cost[ends - lengths]
        return out


def train(docs: DataFrame, plain: bool = False) -> ContextTrees | None:
    """Trees learned from all rows with text and language; None if there are none.

    The distinct four-grams of each language come to the driver with their counts, all of them
    or, if ``plain``, those of letters that two texts of the language share.
    """
    small_batches(docs.sparkSession)
    paths = count_paths(docs, plain).toPandas()
    if paths.empty:
        return None
    return ContextTrees(sorted(paths["lang"].unique()), paths)


def predict(
    docs: DataFrame, trees: ContextTrees | Broadcast | None, keep: list[str], plain: bool = False
) -> DataFrame:
    """``lang_pred``, ``score``, ``bits_per_byte`` and ``judged_bytes`` of every text, with the columns ``keep``.

    Whole texts are judged, or what ``letters`` leaves of them if ``plain``.
    ``score`` is the share of the best language if code lengths are read as
    likelihoods. NULL texts and texts without a letter are ``und`` with score 0, as is
    all if nothing was learned. Ties go to the first language by name. Texts of any length
    are judged whole; repeated rows each get their row; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # A text that is kept travels once.
    kept = "text" in keep
    inputs = docs.select(*keep, has_letter.alias("_letters") if kept else F.when(has_letter, F.col("text")).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    schema = ", ".join([*fields, "lang_pred string, score double, bits_per_byte double, judged_bytes long"])

    if trees is None:
        # Nothing was learned.
        none = F.lit(None).cast("double")
        return inputs.drop("_text", "_letters").withColumns(
            {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": none, "judged_bytes": none.cast("long")}
        )
    shared = trees if isinstance(trees, Broadcast) else docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        model = shared.value
        for batch in batches:
            found = batch["text"].where(batch.pop("_letters"), None) if kept else batch.pop("_text")
            texts = [(letters(t) if plain else t).encode() if t is not None else b"" for t in found]
            bits = model.bits(texts)
            best = bits.argmin(1) if len(bits) else np.zeros(0, int)
            least = bits.min(1, keepdims=True) if len(bits) else bits
            share = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
            empty = np.array([not t for t in texts], bool)
            size = np.array([max(1, len(t)) for t in texts])
            yield batch.assign(
                lang_pred=[UNKNOWN if e else model.langs[b] for e, b in zip(empty, best)],
                score=np.where(empty, 0.0, share),
                bits_per_byte=np.where(empty, np.nan, least[:, 0] / size) if len(bits) else [],
                judged_bytes=[len(t) for t in texts],
            )

    return inputs.mapInPandas(score, schema)


def clean_limits(judged: DataFrame) -> dict[str, float]:
    """Bits a byte that a text of each language may cost, from judged texts; under ``UNKNOWN`` for others.

    Only texts found to be of the language they are labelled with count. Quantiles are mergeable sketches over all rows; one row per language comes back.
    """
    cost = F.percentile_approx("bits_per_byte", [0.5, 0.75], 10_000)
    found = (
        judged.where(F.col("lang_pred") == F.col("lang"))
        .rollup("lang_pred")
        .agg(cost.alias("q"), F.count("bits_per_byte").alias("n"))
        .collect()
    )
    limits = {
        r["lang_pred"] or UNKNOWN: r["q"][0] + SPREADS * max(r["q"][1] - r["q"][0], LEAST_SPREAD)
        for r in found
        if r["n"] >= LEAST_TEXTS
    }
    return limits


@keeps_columns("doc_id", "text", "lang")
def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is no language.

    Those are texts without a letter (NULL and empty ones too) and texts that cost far more
    than clean texts of the language they are most like. Case, marks and words that hold a
    digit are left out, so shouting, keys and numbers in a clean text cost nothing; a text of
    nothing else is judged as it is. The trees are learned from all rows with text and ``lang`` but one part in
    ``PARTS`` by the text's hash, which sets the limit per language (``clean_limits``); copies
    are in one part. Paths of one text alone are left out, so that no text is cheap because it
    was learned itself. If nothing could be learned or fewer than ``LEAST_TEXTS`` texts were kept
    out, only rows without a letter go.
    Repeated rows share their fate; texts of any length are judged whole.
    """
    held = F.pmod(F.xxhash64("text"), F.lit(PARTS)) == 0
    trees = train(docs.where(~held), plain=True)
    limits = {}
    if trees is not None:
        trees = docs.sparkSession.sparkContext.broadcast(trees)
        limits = clean_limits(predict(docs.where(held), trees, ["lang"], plain=True))
    judged = predict(docs, trees, docs.columns, plain=True)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not limits:
        return judged.where(has_letter)
    own = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    limit = F.coalesce(F.try_element_at(own, F.col("lang_pred")), F.lit(limits[UNKNOWN]))
    excess = F.coalesce(F.nanvl("bits_per_byte", F.lit(0.0)) - limit, F.lit(0.0)) * F.col("judged_bytes")
    return judged.where(has_letter & (F.coalesce(excess, F.lit(0.0)) <= EVIDENCE))


@query("op4_language_id")
def op4_language_id(spark, folder):
    """Language of every document, learned from those outside the held-out third."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", id_bucket("doc_id", 3) == 1)
    trees = train(docs.where("not held_out"))
    return predict(docs.drop("lang"), trees, ["doc_id", "held_out"]).drop("judged_bytes")
