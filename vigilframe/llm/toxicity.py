"""Toxicity scores by a factorization machine over hashed terms.

logit(text) = b + sum of w_i + n^-power * sum over pairs i < j of <v_i, v_j>, over the n
distinct terms of a text. The pair part catches what an additive model misses: a word that is
an insult only beside the mention of a group. It costs one pass: it equals half of
|sum of v_i|^2 - sum of |v_i|^2.

From random factors, gradient steps do not find a pair among the many of a long text: they
fit the others by chance. So all pairs of the training rows are tested first, against the
residuals of an additive model fitted on other rows; only terms of significant pairs have
factors, which start at the strengths found. Other terms add nothing to the pair part, so a
trained machine does not divide it by the length of the text (``power`` 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import id_bucket, query, small_batches, table, text_groups
from vigilframe.llm.words import word_hashes

BITS = 18
FACTORS = 8
# The machine is fitted on at most this many labelled rows, those with the smallest
# hash of their id; scoring covers every row.
TRAIN_ROWS = 20_000
# A term seen in fewer training rows than this carries no weight.
MIN_ROWS = 5
EPOCHS = 8
PAIR_EPOCHS = 4
# Sums of pairs are counted in tables of this many cells, from so many pairs at a time.
PAIR_CELLS = 1 << 21
PAIR_STEP = 1 << 22
SEED = 7


def term_ids(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, text after text, and their number per text."""
    found, counts = [], []
    for _, group in text_groups(texts):
        hashes, n = word_hashes(group, marks=True)
        keys = np.repeat(np.arange(len(group), dtype=np.int64) << bits, n)
        keys = np.unique(keys | (hashes >> np.uint64(64 - bits)).astype(np.int64))
        found.append(keys & ((1 << bits) - 1))
        counts.append(np.bincount(keys >> bits, minlength=len(group)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(counts)


class FactorizationMachine:
    def __init__(self, bits: int = BITS, factors: int = FACTORS, seed: int = SEED, power: float = 1.0):
        random = np.random.default_rng(seed)
        self.bits, self.power = bits, power
        self.bias = 0.0
        self.linear = np.zeros(1 << bits, np.float32)
        self.factors = random.normal(0, 0.02, (1 << bits, factors)).astype(np.float32)

    def logits(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(counts)), counts)
        out = self.bias + np.bincount(text, self.linear[terms], len(counts))
        held = self.factors.any(1)[terms]
        text, terms = text[held], terms[held]
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f].astype(np.float64)
            sums = np.bincount(text, v, len(counts))
            out += 0.5 * (sums * sums - np.bincount(text, v * v, len(counts))) / self._sizes(counts)
        return out

    def _sizes(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts, 1) ** self.power

    def fit(
        self, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray,
        epochs: int = EPOCHS, batch: int = 128, rate: float = 0.2, decay: float = 1e-5, seed: int = SEED,
        factor_rate: float = 0.1, factor_decay: float = 1e-5, pair_epochs: int = PAIR_EPOCHS,
    ) -> None:
        """Adagrad steps over shuffled batches of texts; factors that are zero stay zero.

        ``pair_epochs`` come first in which only terms with factors learn, so that the many
        others do not fit by chance what the pairs explain.
        """
        random = np.random.default_rng(seed)
        starts = np.cumsum(counts) - counts
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        g_linear = np.full(self.linear.shape, 1e-2, np.float32)
        # Slopes of pairs are small: their own start lets the first steps count in full.
        g_factors = np.full(self.factors.shape, 1e-6, np.float32)
        has_factors = self.factors.any(1)
        g_bias = 1e-2
        for epoch in range(-pair_epochs if has_factors.any() else 0, epochs):
            order = random.permutation(len(counts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                n = counts[rows]
                text = np.repeat(np.arange(len(rows)), n)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids = terms[np.repeat(starts[rows], n) + inside]
                held = has_factors[ids]
                pair_text, pair_ids = text[held], ids[held]
                v = self.factors[pair_ids]
                sums = np.stack([np.bincount(pair_text, v[:, f], len(rows)) for f in range(v.shape[1])], 1)
                logit = self.bias + np.bincount(text, self.linear[ids], len(rows))
                size = self._sizes(n)
                logit += 0.5 * ((sums * sums).sum(1) - np.bincount(pair_text, (v * v).sum(1), len(rows))) / size
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) / len(rows)
                g_bias += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(g_bias)
                if epoch < 0:
                    text, ids = pair_text, pair_ids
                used, where = np.unique(ids, return_inverse=True)
                e = error[text]
                step = np.bincount(where, e) + decay * self.linear[used]
                g_linear[used] += step * step
                self.linear[used] -= rate * step / np.sqrt(g_linear[used])
                if not len(pair_ids):
                    continue
                used, where = np.unique(pair_ids, return_inverse=True)
                slope = (error / size)[pair_text][:, None] * (sums[pair_text] - v)
                step = np.stack([np.bincount(where, slope[:, f]) for f in range(v.shape[1])], 1)
                step += factor_decay * self.factors[used]
                g_factors[used] += step * step
                self.factors[used] -= factor_rate * step / np.sqrt(g_factors[used])


def additive_residuals(terms: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label minus probability, and its variance, of each row under an additive model fitted on the other half."""
    chance = np.empty(len(labels))
    half = np.arange(len(labels)) % 2
    in_half = np.repeat(half, counts)
    for k in (0, 1):
        machine = FactorizationMachine(factors=1)
        machine.factors[:] = 0
        machine.fit(terms[in_half != k], counts[half != k], labels[half != k])
        logits = machine.logits(terms[in_half == k], counts[half == k])
        chance[half == k] = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    chance = np.clip(chance, 1e-3, 1 - 1e-3)
    return labels - chance, chance * (1 - chance)


def pair_sums(first: int, last: int, n_terms: int, terms, counts, postings, bounds, values) -> list[np.ndarray]:
    """Sums of each of ``values`` over the texts that hold term a (``first`` to ``last``) and a later term b.

    ``terms`` ascend within a text; ``postings`` are their places, by term; ``bounds`` the terms' first postings.
    """
    ends = np.cumsum(counts)
    places = postings[bounds[first] : bounds[last]]
    text = np.searchsorted(ends, places, "right")
    later = ends[text] - places - 1
    sums = [np.zeros((last - first) * n_terms) for _ in values]
    cuts = np.searchsorted(np.cumsum(later), np.arange(PAIR_STEP, later.sum() + 1, PAIR_STEP))
    for part in np.split(np.arange(len(places)), cuts):
        n = later[part]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = terms[np.repeat(places[part] + 1, n) + inside]
        cell = np.repeat((terms[places[part]].astype(np.int64) - first) * n_terms, n) + other
        for out, value in zip(sums, values):
            out += np.bincount(cell, np.repeat(value[text[part]], n), len(out))
    return [x.reshape(last - first, n_terms) for x in sums]


def may_pair(numbers: np.ndarray, text: np.ndarray, residual: np.ndarray, variance: np.ndarray, limit: float) -> np.ndarray:
    """False for every term of which no pair can score above ``limit``; exact, never an estimate.

    A pair's score is below sqrt(3 |T|). Its T is the residuals' sum over the shared texts, at most the
    absolute residuals of either term, less the shared variance times what each term does alone. The
    shared variance is at most the smaller one of the two terms: for its own part that gives the term's
    own residual sum, for the other's the largest residual sum among terms of less
    variance, or its own variance times the largest such shift among terms of more.
    """
    own = np.bincount(numbers, variance[text])
    sums = np.abs(np.bincount(numbers, residual[text]))
    order = np.argsort(own, kind="stable")
    lesser = np.maximum.accumulate(sums[order])
    greater = np.maximum.accumulate((sums / own)[order][::-1])[::-1]
    other = np.empty(len(own))
    other[order] = np.maximum(lesser, own[order] * np.append(greater[1:], 0.0))
    most = np.bincount(numbers, np.abs(residual[text])) + sums + other
    # A little slack for rounding keeps what lies at the limit.
    return 3 * most * (1 + 1e-9) >= limit * limit


def strong_pairs(spark: SparkSession, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
    """(a, b, strength): all pairs of terms that shift the logit beyond what the terms do alone.

    A pair counts if Bernstein's bound on its residuals' sum leaves no such pair by chance.
    Terms whose support rules that out (``may_pair``) are left out; every pair of the others in
    every row is counted, by ranges of terms in the workers.
    """
    known, numbers = np.unique(terms, return_inverse=True)
    if not len(known):
        return pd.DataFrame({"a": [], "b": [], "strength": []}).astype("int64")
    residual, variance = additive_residuals(terms, counts, labels)
    n_terms = len(known)
    text = np.repeat(np.arange(len(counts)), counts)
    alone = np.bincount(numbers, residual[text]) / np.bincount(numbers, variance[text])
    limit = np.sqrt(2 * np.log(max(2, n_terms * (n_terms - 1) / 2))) + 0.5
    able = may_pair(numbers, text, residual, variance, limit)
    here = able[numbers]
    counts = np.bincount(text[here], minlength=len(counts))
    numbers = (np.cumsum(able) - 1)[numbers[here]]
    known, alone, n_terms = known[able], alone[able], int(able.sum())
    if not n_terms:
        return pd.DataFrame({"a": [], "b": [], "strength": []}).astype("int64")
    bounds = np.append(0, np.cumsum(np.bincount(numbers, minlength=n_terms)))
    postings = np.argsort(numbers, kind="stable").astype(np.int32)
    shared = spark.sparkContext.broadcast(
        (numbers.astype(np.int32), counts, postings, bounds, [residual, variance], alone)
    )
    step = max(1, PAIR_CELLS // n_terms)

    def test(batches):
        numbers, counts, postings, bounds, values, alone = shared.value
        for batch in batches:
            for first in batch["id"]:
                last = min(first + step, n_terms)
                total, spread = pair_sums(first, last, n_terms, numbers, counts, postings, bounds, values)
                total -= spread * (alone[first:last, None] + alone[None, :])
                score = np.abs(total) / np.sqrt(np.maximum(spread + np.abs(total) / 3, 1e-9))
                a, b = np.nonzero((score > limit) & (spread > 0))
                strength = total[a, b] / (spread[a, b] + 1)
                yield pd.DataFrame({"a": known[a + first], "b": known[b], "strength": strength})

    firsts = spark.range(0, n_terms, step, min(-(-n_terms // step), 4 * spark.sparkContext.defaultParallelism))
    return firsts.mapInPandas(test, "a long, b long, strength double").toPandas()


def start_factors(machine: FactorizationMachine, pairs: pd.DataFrame, rounds: int = 50) -> None:
    """Factors from the leading eigenvectors of the pairs' strengths; zero for all other terms."""
    width = machine.factors.shape[1]
    machine.factors[:] = 0
    if pairs.empty:
        return
    ids, where = np.unique(pairs[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = where.reshape(-1, 2).T
    s = np.clip(pairs["strength"].to_numpy(float), -4, 4)
    times = lambda x: np.stack(
        [np.bincount(a, s * c[b], len(ids)) + np.bincount(b, s * c[a], len(ids)) for c in x.T], 1
    )
    # Shifted, so that the largest eigenvalues lead and not the largest in size.
    shift = (np.bincount(a, abs(s), len(ids)) + np.bincount(b, abs(s), len(ids))).max()
    found = np.random.default_rng(SEED).normal(size=(len(ids), width))
    for _ in range(rounds):
        found = np.linalg.qr(times(found) + shift * found)[0]
    value = np.maximum((found * times(found)).sum(0), 0)
    machine.factors[ids, : found.shape[1]] = found * np.sqrt(value)
    # A small push apart, so that no term of a pair is left at zero.
    machine.factors[ids] += np.random.default_rng(SEED).normal(0, 0.02, (len(ids), width))


def train(labelled: DataFrame, max_rows: int = TRAIN_ROWS, min_rows: int = MIN_ROWS) -> FactorizationMachine:
    """Fit on rows (doc_id, text, toxic); rows without a label or text are left out.

    At most ``max_rows`` rows come to the driver, as hashed terms. Without both
    labels, the machine gives the share of toxic rows (or 0.5 without any row).
    """
    small_batches(labelled.sparkSession)

    def cut(batches):
        for batch in batches:
            terms, counts = term_ids([t.encode() for t in batch["text"]])
            parts = np.split(terms.astype(np.int32), np.cumsum(counts)[:-1]) if len(counts) else []
            yield pd.DataFrame({"toxic": batch["toxic"], "terms": [p.tobytes() for p in parts]})

    sample = (
        labelled.where("toxic is not null and text is not null")
        .select(F.xxhash64(F.lit(SEED), "doc_id").alias("h"), "doc_id", "text", F.col("toxic").cast("double"))
        .orderBy("h", "doc_id", "text")
        .limit(max_rows)
        .select("text", "toxic")
    )
    rows = sample.mapInPandas(cut, "toxic double, terms binary").toPandas()
    machine = FactorizationMachine(power=0.0)
    if rows.empty:
        return machine
    labels = (rows["toxic"].to_numpy() > 0).astype(float)
    lists = [np.frombuffer(t, np.int32).astype(np.int64) for t in rows["terms"]]
    common = np.bincount(np.concatenate(lists), minlength=1 << machine.bits) >= min_rows
    lists = [x[common[x]] for x in lists]
    counts = np.array([len(x) for x in lists])
    terms = np.concatenate(lists)
    start_factors(machine, strong_pairs(labelled.sparkSession, terms, counts, labels))
    machine.fit(terms, counts, labels)
    return machine


def with_score(docs: DataFrame, machine: FactorizationMachine, keep: list[str]) -> DataFrame:
    """``score`` (0 to 1) of every whole text, with the columns ``keep``; NULL counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def score(batches):
        model = shared.value
        for batch in batches:
            logits = model.logits(*term_ids([(t or "").encode() for t in batch.pop("_text")], model.bits))
            yield batch.assign(score=1 / (1 + np.exp(-np.clip(logits, -500, 500))))

    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInPandas(score, ", ".join([*fields, "score double"]))


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    """Toxicity of every document, learned from labels outside the held-out fifth."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    docs = docs.withColumn("held_out", id_bucket("doc_id", 5) == 0)
    # Ids are chosen before texts are fetched, so that only a sample's texts move.
    chosen = (
        labels.where((id_bucket("doc_id", 5) != 0) & F.col("toxic").isNotNull())
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "toxic")
        .limit(TRAIN_ROWS)
    )
    # At most TRAIN_ROWS ids of eight bytes: small enough to send to every executor.
    machine = train(docs.join(F.broadcast(chosen), "doc_id"))
    scored = with_score(docs, machine, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
