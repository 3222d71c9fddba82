"""Ranked retrieval: keyword search (BM25), synonym retry, vector search, fusion.

Many queries run against many documents in one job. The inverted index is a
table (doc_id, doc_len, term, tf), built once and written to the shared folder
when it serves several searches.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.scalars import score_band
from vigilframe.plans.skew import ROWS_PER_TASK, lookup_join, null_safe_join
from vigilframe.session import shuffles_dropped, written

K1, B = 1.2, 0.75
RRF = 60
DIGITS = 6

# Business terms and the table words they stand for.
SYNONYMS = {
    "주문": "orders",
    "결제": "payments",
    "사용자": "users",
    "회원": "users",
    "상품": "products",
    "카테고리": "categories",
    "리뷰": "reviews",
    "재고": "inventory",
    "배송": "shipping",
    "주소": "addresses",
    "건수": "count",
    "수량": "quantity",
    "금액": "amount",
    "매출": "revenue",
    "매출액": "revenue",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, over the whole text."""
    words = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", spread: bool = True) -> DataFrame:
    """Postings (doc_id, doc_len, term, tf); every row is one document.

    Terms are counted inside the row: its sorted words are cut into runs. So the index
    needs no exchange beyond ``spread``, which deals texts by id and is worth it only
    where a table has fewer files than the cluster has cores.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    if spread:
        rows = rows.repartition("doc_id")
    words = rows.select("doc_id", F.sort_array(tokens(F.col("_t"))).alias("_w"))
    starts = F.filter(
        F.transform("_w", lambda w, i: F.when((i == 0) | (w != F.get("_w", i - 1)), i)), lambda i: i.isNotNull()
    )
    runs = words.select("doc_id", F.size("_w").alias("doc_len"), "_w", starts.alias("_s"))
    posting = lambda s, i: F.struct(
        F.get("_w", s).alias("term"), (F.coalesce(F.get("_s", i + 1), "doc_len") - s).cast("long").alias("tf")
    )
    return runs.select("doc_id", "doc_len", F.inline(F.transform("_s", posting)))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(
        F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")
    )


def keyword_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 score of every document that shares a term with a query.

    Document frequencies are needed for query terms only; they are also the
    row counts by which a term held by very many documents is split.
    """
    terms = query_terms(queries)
    stats = index.agg(
        F.struct(F.count_distinct("doc_id").alias("docs"), F.sum("tf").alias("words"))
    ).scalar()
    df = written(
        index.join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df")),
        "document-frequency",
    )
    idf = F.ln(1 + (stats["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").select("query_id", "term", idf.alias("idf"))
    norm = 1 - B + B * F.col("doc_len") / (stats["words"] / stats["docs"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return (
        lookup_join(index, weighted, ["term"], ["doc_id"], "inner", rows="df", sized=df)
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(part), DIGITS).alias("score"))
    )


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents per query; map tasks keep only their own best ``k``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Postings of a term are dealt to this many blocks by their part of the score.
LEVELS = 8
# The first threshold comes from a query's rarest terms, up to this many postings for each of the k results.
SEED_POSTINGS = 400
# Below this many postings of all terms of all queries, planning costs more than scanning them.
SCAN_ALL = 30_000_000
# Terms are left for later while all of them together reach less than this share of the threshold.
LATER = 0.7
# Scores are rounded: what lies this far below the threshold cannot tie with it.
MARGIN = 2.0 * 10**-DIGITS


# A task of a large search scores about this many postings, for queries of about this many terms in all.
BLOCK_POSTINGS = 2_000_000
CHUNK_TERMS = 1_000_000
# A round of a large search has about this many pairs of blocks and chunks, or all blocks of one chunk.
PAIRS_AT_ONCE = 64
# A term in at least this share of a block's documents is kept as one number per document.
DENSE = 0.25
# Documents are looked at in groups of this many for a first bound on the k-th best.
GROUP = 64


def best_of_block(stored: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Best ``k`` documents of one block (doc_id, t, part) for each query of one chunk (q, t), with their sums of parts.

    All that can be among the best ``k`` after rounding are returned. Of equal sums the first ``k`` by id
    suffice. Parts of a repeated id add up, as do the terms of a repeated query.
    """
    terms = np.intersect1d(stored["t"].to_numpy(), queries["t"].to_numpy())
    stored = stored.filter(pc.is_in(stored["t"], pa.array(terms)))
    queries = queries.filter(pc.is_in(queries["t"], pa.array(terms)))
    ids = pc.unique(stored["doc_id"])
    ids = ids.take(pc.array_sort_indices(ids, null_placement="at_start"))
    n = len(ids)
    found_q, found_doc, found_part = [], [], []
    if n:
        # Postings by term, one per document; documents numbered in the order of their ids.
        doc = pc.index_in(stored["doc_id"], value_set=ids).to_numpy().astype(np.int64)
        key, place = np.unique(np.searchsorted(terms, stored["t"].to_numpy()) * n + doc, return_inverse=True)
        part = np.bincount(place, weights=stored["part"].to_numpy(), minlength=len(key))
        doc, ends = key % n, np.searchsorted(key, np.arange(len(terms) + 1) * n)
        docs = [doc[a:b] for a, b in zip(ends, ends[1:])]
        parts = [part[a:b] for a, b in zip(ends, ends[1:])]
        width = -(-n // GROUP) * GROUP
        dense = {}
        for t in np.flatnonzero(np.diff(ends) >= DENSE * n):
            dense[t] = np.zeros(width)
            dense[t][docs[t]] = parts[t]
        asked = np.sort(queries["q"].to_numpy(), kind="stable")
        order = np.lexsort((queries["t"].to_numpy(), queries["q"].to_numpy()))
        asked_terms = np.searchsorted(terms, queries["t"].to_numpy()[order])
        starts = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.empty(0, np.int64)
        sums = np.empty(width)
        for a, b in zip(starts, np.r_[starts[1:], len(asked)]):
            sums[:] = 0.0
            for t in asked_terms[a:b]:
                if t in dense:
                    sums += dense[t]
                else:
                    sums[docs[t]] += parts[t]
            least = 0.0
            if width // GROUP > k:
                # As many groups as results hold a document of at least this sum.
                least = np.partition(sums.reshape(-1, GROUP).max(axis=1), -k)[-k]
            if least > MARGIN:
                seen = np.flatnonzero(sums >= least - MARGIN)
            else:
                # Sums of very frequent terms may be zero or less: only documents met count.
                seen = np.unique(np.concatenate([docs[t] for t in asked_terms[a:b]]))
            values = sums[seen]
            if len(seen) > k:
                near = values >= np.partition(values, -k)[-k] - MARGIN
                seen, values = seen[near], values[near]
                by = np.lexsort((seen, -values))
                seen, values = seen[by], values[by]
                first = np.r_[True, values[1:] != values[:-1]]
                place = np.arange(len(values))
                early = place - np.maximum.accumulate(np.where(first, place, 0)) < k
                seen, values = seen[early], values[early]
            found_q.append(np.full(len(seen), asked[a]))
            found_doc.append(seen)
            found_part.append(values)
    joined = lambda found, kind: np.concatenate([*found, np.empty(0, kind)])
    return pa.table(
        {
            "q": pa.array(joined(found_q, np.int64), pa.int64()),
            "doc_id": ids.take(pa.array(joined(found_doc, np.int64), pa.int64())),
            "part": pa.array(joined(found_part, np.float64), pa.float64()),
        }
    )


class KeywordSearch:
    """Exact BM25 top ``k`` of many queries that leaves out what cannot enter the top ``k``.

    Postings of a term form blocks by their part of the score, each with its size and its
    largest part. From those come, per query and term, the most the term can give. A first
    threshold is the k-th best full score among documents of the query's rarest terms. Then

    * terms that together cannot reach the threshold are not scanned for candidates (MaxScore);
    * blocks whose best posting plus the most of all other terms stays below the threshold are skipped;
    * a candidate whose score so far plus the most of the terms left stays below it is dropped.

    Only what remains is scored by the terms left. Small searches are scanned whole, which
    gives the same rows. Whatever the threshold, results equal those of scoring every posting; queries with fewer than ``k`` documents to start with have no threshold.
    Tables per query and term are written, so that Spark joins them by their measured size.

    Large searches are dealt: blocks of documents meet chunks of queries, one task a pair, which scores all
    postings of the block and passes on only the best ``k`` of each query. So each posting asked for is
    shuffled once per chunk, not once per query that asks for it, and few chunks at a time.
    """

    def __init__(self, index: DataFrame, queries: DataFrame, k: int):
        self.k = k
        with shuffles_dropped(index.sparkSession):
            totals = index.agg(F.count_distinct("doc_id"), F.sum("tf")).first()
        self.docs, words = totals[0], totals[1] or 0
        norm = 1 - B + B * F.col("doc_len") / (words / max(self.docs, 1))
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
        level = F.floor(F.col("impact") * LEVELS / (K1 + 1)).cast("int")
        self.postings = index.select("doc_id", "term", impact.alias("impact")).withColumn("level", level)
        self.asked = query_terms(queries)
        self.blocks = written(
            self.postings.join(self.asked.select("term").distinct(), "term", "left_semi")
            .groupBy("term", "level")
            .agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most")),
            "posting-blocks",
        )
        self.df = self.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
        idf = F.ln(1 + (self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = self.asked.join(self.df, "term").select(
            "query_id", "term", "df", idf.alias("idf"), (idf * F.col("most")).alias("most")
        )
        self.weighted = written(weighted, "query-weights")
        size = self.weighted.agg(F.sum("df"), F.max("df")).first()
        self.postings_met = size[0] or 0
        # Only terms of very many postings are salted.
        self.sizes = {"rows": "df", "sized": self.df} if (size[1] or 0) > ROWS_PER_TASK else {}

    def _with_bounds(self) -> DataFrame:
        """Terms with the most that the other terms, and all lesser ones, can add; a query is a few terms."""
        of_query = Window.partitionBy("query_id")
        return written(
            self.weighted.withColumns(
                {
                    "others": F.sum("most").over(of_query) - F.col("most"),
                    "reached": F.sum("most").over(of_query.orderBy("most", "term")),
                    "before": F.sum("df").over(of_query.orderBy("df", "term")) - F.col("df"),
                }
            ),
            "query-terms",
        )

    def _met(self, terms: DataFrame) -> DataFrame:
        if self.sizes:
            return lookup_join(self.postings, terms, ["term"], ["doc_id"], "inner", **self.sizes)
        return self.postings.join(terms, "term")

    @staticmethod
    def _summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))

    def _finished(self, partial: DataFrame, later: DataFrame) -> DataFrame:
        """Partial sums plus the terms left, which are looked up for these documents only."""
        asked = partial.join(later.select("query_id", "term", "idf"), "query_id")
        asked = written(asked.select("query_id", "doc_id", "term", "idf"), "look-ups")
        rest = (
            self.postings.join(later.select("term").distinct(), "term", "left_semi")
            .join(asked, ["doc_id", "term"])
            .select("query_id", "doc_id", (F.col("idf") * F.col("impact")).alias("part"))
        )
        return self._summed(partial.unionByName(rest)).select(
            "query_id", "doc_id", F.round("part", DIGITS).alias("score")
        )

    def thresholds(self, terms: DataFrame) -> DataFrame:
        """(query_id, least): no document below ``least`` is among the best ``k``; written."""
        rare = F.col("before") < SEED_POSTINGS * self.k
        part = (F.col("idf") * F.col("impact")).alias("part")
        seen = self._summed(self._met(terms.where(rare)).select("query_id", "doc_id", part))
        first = written(top_k(seen.withColumnRenamed("part", "score"), self.k), "first-documents")
        full = self._finished(
            first.select("query_id", "doc_id", F.col("score").alias("part")), terms.where(~rare)
        )
        least = full.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("_n"))
        return written(least.where(F.col("_n") == self.k).drop("_n"), "thresholds")

    def plan(self) -> DataFrame:
        """Per query and term: ``later`` (not scanned for candidates), else ``first_level``, the lowest block scanned.

        ``rest`` is the most that the query's later terms give together. Written.
        """
        later = F.coalesce(F.col("reached") < LATER * F.col("least"), F.lit(False))
        rest = F.sum(F.when(later, F.col("most")).otherwise(0.0)).over(Window.partitionBy("query_id"))
        terms = self._with_bounds()
        known = terms.join(self.thresholds(terms), "query_id", "left").withColumns({"later": later, "rest": rest})
        # The best part of a block grows with its level: all blocks from the first that can matter are scanned.
        needed = (F.col("least") - MARGIN - F.col("others")) / F.col("idf")
        levels = self.blocks.groupBy("term").agg(
            F.sort_array(F.collect_list(F.struct("level", "n", "most"))).alias("levels")
        )
        matter = F.filter("levels", lambda x: x["most"] >= F.coalesce(needed, F.lit(0.0)))
        scanned = F.aggregate(matter, F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return written(
            known.join(levels, "term")
            .withColumns({"first_level": F.try_element_at(matter, F.lit(1))["level"], "scanned": scanned})
            .drop("levels", "reached", "before"),
            "search-plan",
        )

    def results(self) -> DataFrame:
        return self.dealt() if self.postings_met > SCAN_ALL else self.scanned()

    def dealt(self) -> DataFrame:
        """Every posting of every term scored where its block of documents meets a chunk of queries.

        Chunks come in rounds of few pairs. A round deals the blocks to its own chunks, writes their best documents and
        drops what it shuffled; so postings lie on disk as often as a round has chunks, not as often as there are chunks.
        """
        ids = F.monotonically_increasing_id()
        terms = written(
            self.df.select("term", "df", (F.ln(1 + (self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
            .withColumn("t", ids),
            "asked-terms",
        )
        numbers = written(self.asked.select("query_id").distinct().withColumn("q", ids), "query-numbers")
        sizes = terms.agg(F.sum("df")).first()[0] or 0, self.weighted.count()
        blocks, chunks = (max(1, math.ceil(n / most)) for n, most in zip(sizes, (BLOCK_POSTINGS, CHUNK_TERMS)))
        at_once = max(1, PAIRS_AT_ONCE // blocks)
        stored = self._met(terms).select(
            F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", F.col("t").alias("t"),
            (F.col("idf") * F.col("impact")).alias("part"),
        )
        asked = (
            null_safe_join(self.asked, numbers, ["query_id"], "inner").join(terms.select("term", "t"), "term")
            .select(F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("chunk"), "q", F.col("t").alias("t"))
        )
        if chunks <= at_once:
            return self._round(stored, asked, numbers, blocks, range(chunks))
        stored, asked = written(stored, "asked-postings"), written(asked, "query-chunks")
        rounds = [range(c, min(c + at_once, chunks)) for c in range(0, chunks, at_once)]
        found = [written(self._round(stored, asked, numbers, blocks, chosen), "round") for chosen in rounds]
        return reduce(DataFrame.unionByName, found)

    def _round(self, stored: DataFrame, asked: DataFrame, numbers: DataFrame, blocks: int, chunks: range) -> DataFrame:
        """Best ``k`` of the queries of some chunks: all blocks of postings meet them, a task a pair."""
        k, pair, tasks = self.k, ["block", "chunk"], 2 * blocks * len(chunks)
        every = lambda of: F.explode(F.sequence(F.lit(of[0]), F.lit(of[-1])))
        postings = stored.select("block", every(chunks).alias("chunk"), "doc_id", "t", "part")
        queries = asked.where(F.col("chunk").between(chunks[0], chunks[-1])).select(
            every(range(blocks)).alias("block"), "chunk", "q", "t"
        )
        schema = f"q long, doc_id {stored.schema['doc_id'].dataType.simpleString()}, part double"
        best = (
            postings.repartition(tasks, *pair).groupBy(*pair)
            .cogroup(queries.repartition(tasks, *pair).groupBy(*pair))
            .applyInArrow(lambda a, b: best_of_block(a, b, k), schema)
        )
        scores = best.join(numbers, "q").select("query_id", "doc_id", F.round("part", DIGITS).alias("score"))
        return top_k(scores, k)

    def scanned(self) -> DataFrame:
        """Every posting of every term scored."""
        parts = self._met(self.weighted.select("query_id", "term", "idf", "df"))
        total = F.round(F.sum(F.col("idf") * F.col("impact")), DIGITS)
        return top_k(parts.groupBy("query_id", "doc_id").agg(total.alias("score")), self.k)

    def pruned(self) -> DataFrame:
        plan = self.plan()
        scanned = plan.where("not later and first_level is not null").select(
            "query_id", "term", "idf", "first_level", "rest", "least"
        )
        parts = self._met(scanned).where("level >= first_level")
        alive = F.coalesce(F.col("part") + F.col("rest") >= F.col("least") - MARGIN, F.lit(True))
        partial = (
            parts.groupBy("query_id", "doc_id", "rest", "least")
            .agg(F.sum(F.col("idf") * F.col("impact")).alias("part"))
            .where(alive)
            .select("query_id", "doc_id", "part")
        )
        return top_k(self._finished(written(partial, "candidates"), plan.where("later")), self.k)


def keyword_search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` documents per query by BM25; see :class:`KeywordSearch` for what is left out."""
    return KeywordSearch(index, queries, k).results()


def expand(text: Column, synonyms: Mapping[str, str] = SYNONYMS) -> Column:
    """Text followed by the words of every business term it contains."""
    added = F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(term)), F.lit(word)) for term, word in synonyms.items()])
    )
    return F.when(F.size(added) > 0, F.concat(text, F.lit(" "), F.array_join(added, " "))).otherwise(text)


def search_with_retry(
    index: DataFrame,
    queries: DataFrame,
    k: int = 3,
    low_score: float = 0.5,
    synonyms: Mapping[str, str] = SYNONYMS,
) -> DataFrame:
    """Search; where the best score is low, search the expanded text and keep it if it is strictly better.

    A query without any hit is answered as it is. Both texts of a query are
    ranked in one pass over the index.
    """
    both = queries.select(
        F.col("query_id").alias("_q"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_try"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("_try"), expand(F.col("text"), synonyms).alias("text")),
            )
        ),
    ).select(F.struct("_q", "_try").alias("query_id"), "text")
    found = keyword_search(index, both, k)
    rows = found.select("query_id._q", "query_id._try", "doc_id", "score", "rank")
    best = rows.groupBy("_q").agg(
        F.max(F.when(F.col("_try") == 0, F.col("score"))).alias("_first"),
        F.max(F.when(F.col("_try") == 1, F.col("score"))).alias("_second"),
    )
    use_second = (F.col("_first") < low_score) & (F.col("_second") > F.col("_first"))
    chosen = F.when(F.col("_first").isNotNull(), F.when(use_second, 1).otherwise(0))
    return (
        rows.join(best, "_q")
        .where(F.col("_try") == chosen)
        .select(F.col("_q").alias("query_id"), "doc_id", "score", "rank", (F.col("_try") == 1).alias("expanded"))
    )


def recommend(index: DataFrame, queries: DataFrame, max_tables: int = 5, min_score: float = 0.3) -> DataFrame:
    """From the best ``2 * max_tables``, those above the minimum score, at most ``max_tables``, with a reason."""
    return (
        keyword_search(index, queries, 2 * max_tables)
        .where((F.col("score") >= min_score) & (F.col("rank") <= max_tables))
        .withColumn("reason", score_band(F.col("score")))
    )


# --- vectors --------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def dimension_check(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Adds the number of dimensions and whether it is the expected one."""
    n = F.coalesce(F.size(vector), F.lit(0))
    return vectors.withColumn("dim", F.greatest(n, F.lit(0))).withColumn("is_valid", F.col("dim") == dim)


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key."""
    cells = vectors.select(key, F.posexplode(vector).alias("_pos", "_x"))
    means = cells.groupBy(key, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    items = F.sort_array(F.collect_list(F.struct("_pos", "_m")))
    return means.groupBy(key).agg(F.transform(items, lambda i: i["_m"]).alias(vector))


# Stored vectors are grouped around this many of them at most; they travel with the plan.
PIVOTS_MOST = 256
# Grouping compares every stored vector with every pivot: it pays for this many times more queries than pivots.
QUERIES_PER_PIVOT = 4
# Angles are exact to far less than this.
ANGLE_SLACK = 1e-6


class VectorSearch:
    """Exact cosine top ``k`` of many query vectors over stored ones.

    Few queries travel with the plan and meet every stored vector where it lies. Many
    queries meet groups instead: stored vectors are dealt to the nearest of a bounded number of
    pivots, and each group knows the least and largest angle to its pivot. A query's angle
    to a pivot then bounds its angle to every member (triangle inequality), so a group whose best
    possible cosine stays below the query's k-th best so far is skipped. What remains is one
    join on the group, both sides partitioned, large groups salted by their known size. Either
    way gives the same rows. Vectors that are NULL, zero or not finite have no cosine, nor have pairs of different length.
    """

    def __init__(
        self, vectors: DataFrame, queries: DataFrame, k: int, doc_id: str, vector: str, block_bytes: int = 4 << 20
    ):
        self.k, self.block_bytes = k, block_bytes
        self.asked = queries.select("query_id", F.col(vector).alias("_qv"))
        # Each distinct query vector is searched once.
        self.queries = written(
            self.asked.select("_qv")
            .distinct()
            .withColumns({"_q": F.monotonically_increasing_id(), "_qn": norm(F.col("_qv"))})
            .where(_has_direction(F.col("_qn"))),
            "query-vectors",
        )
        self.stored = (
            vectors.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("_v"))
            .withColumn("_n", norm(F.col("_v")))
            .where(_has_direction(F.col("_n")))
        )
        self.score = F.round(
            F.try_divide(dot(F.col("_v"), F.col("_qv")), F.col("_n") * F.col("_qn")), DIGITS
        ).alias("score")

    def results(self) -> DataFrame:
        pivots = self.pivot_count()
        count, size = self.queries.agg(F.count(F.lit(1)), F.sum(F.size("_qv") * 8 + 32)).first()
        few = count <= QUERIES_PER_PIVOT * pivots and (size or 0) <= self.block_bytes
        found = self.scanned() if few else self.grouped(pivots)
        return self.asked.join(self.queries.select("_qv", "_q"), "_qv").join(found, "_q").drop("_q", "_qv")

    def pivot_count(self) -> int:
        """About the square root of the stored vectors, as far as the pivots' bytes allow."""
        count, longest = self.stored.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
        fitting = self.block_bytes // ((longest or 1) * 8 + 32)
        return max(1, min(PIVOTS_MOST, fitting, math.ceil(math.sqrt(count))))

    def _best(self, scored: DataFrame) -> DataFrame:
        return top_k(scored.withColumnRenamed("_q", "query_id"), self.k).withColumnRenamed("query_id", "_q")

    def scanned(self) -> DataFrame:
        """Every stored vector against all queries, of which there are a bounded number."""
        together = self.queries.select(F.struct("_q", "_qv", "_qn").alias("q")).agg(F.collect_list("q"))
        pairs = self.stored.withColumn("_x", F.explode(together.scalar())).select("doc_id", "_v", "_n", "_x.*")
        return self._best(pairs.select("doc_id", "_q", self.score).where("score is not null"))

    # --- groups -------------------------------------------------------------------------

    def deal(self, pivots: int) -> None:
        """Groups of stored vectors (written), their sizes and angles, and every query's bound per group."""
        by_length = Window.partitionBy("_d").orderBy(F.xxhash64("_v"), "doc_id")
        chosen = written(
            self.stored.withColumn("_d", F.size("_v"))
            .withColumn("_g", F.row_number().over(by_length))
            .where(F.col("_g") <= pivots)
            .select("_d", "_g", F.col("_v").alias("_p"), F.col("_n").alias("_pn")),
            "pivots",
        )
        all_pivots = chosen.select(F.struct("_d", "_g", "_p", "_pn").alias("p")).agg(F.collect_list("p")).scalar()

        def angle(vector: str, length: str, p: Column) -> Column:
            cosine = dot(F.col(vector), p["_p"]) / (F.col(length) * p["_pn"])
            return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

        same_length = lambda vector: F.filter("_all", lambda p: p["_d"] == F.size(vector))
        near = F.array_min(
            F.transform(same_length("_v"), lambda p: F.struct(angle("_v", "_n", p).alias("a"), p["_g"].alias("g")))
        )
        dealt = (
            self.stored.withColumn("_all", all_pivots)
            .withColumn("_near", near)
            .select("doc_id", "_v", "_n", F.size("_v").alias("_d"), F.col("_near.g").alias("_g"), F.col("_near.a").alias("_a"))
        )
        self.members = written(dealt, "vector-groups")
        self.groups = written(
            self.members.groupBy("_d", "_g").agg(
                F.count(F.lit(1)).alias("n"), F.min("_a").alias("low"), F.max("_a").alias("high")
            ),
            "group-angles",
        )
        angles = self.queries.withColumn("_all", all_pivots).select(
            "_q",
            F.size("_qv").alias("_d"),
            F.inline(F.transform(same_length("_qv"), lambda p: F.struct(p["_g"].alias("_g"), angle("_qv", "_qn", p).alias("_qa")))),
        )
        # No member is nearer to the query than the gap between the angles to the pivot.
        gap = F.greatest(F.lit(0.0), F.col("_qa") - F.col("high"), F.col("low") - F.col("_qa")) - ANGLE_SLACK
        bounded = angles.join(self.groups, ["_d", "_g"]).withColumn("most", F.cos(F.greatest(F.lit(0.0), gap)) + MARGIN)
        self.bounds = written(bounded.select("_q", "_d", "_g", "n", "_qa", "most"), "query-bounds")

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """Scores of all members of the groups in (``_q``, ``_d``, ``_g``)."""
        asked = pairs.select("_q", "_d", "_g").join(self.queries, "_q")
        sized = self.groups.select("_d", "_g", "n")
        largest = self.groups.agg(F.max("n")).first()[0] or 0
        if largest > ROWS_PER_TASK:
            met = lookup_join(self.members, asked, ["_d", "_g"], ["doc_id"], "inner", rows="n", sized=sized)
        else:
            met = self.members.join(asked, ["_d", "_g"])
        return met.select("doc_id", "_q", self.score).where("score is not null")

    def plan(self) -> tuple[DataFrame, DataFrame]:
        """(scores of every query's nearest groups, (query, group) pairs that can still matter besides)."""
        # Nearest groups first, until they hold k vectors.
        order = Window.partitionBy("_q").orderBy("_qa", "_g")
        ranked = self.bounds.withColumn("_before", F.sum("n").over(order) - F.col("n"))
        ranked = written(ranked.withColumn("_first", F.col("_before") < self.k), "ranked-groups")
        first = written(self._best(self._compared(ranked.where("_first"))), "first-neighbours")
        least = first.groupBy("_q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("_k"))
        least = least.where(F.col("_k") == self.k).drop("_k")
        rest = ranked.where("not _first").join(least, "_q", "left")
        return first, rest.where(F.coalesce(F.col("most") >= F.col("least"), F.lit(True)))

    def grouped(self, pivots: int) -> DataFrame:
        self.deal(pivots)
        first, rest = self.plan()
        return self._best(first.drop("rank").unionByName(self._compared(rest)))


def _has_direction(length: Column) -> Column:
    return F.coalesce((length > 0) & ~F.isnan(length) & (length < float("inf")), F.lit(False))


def vector_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    doc_id: str = "vec_id",
    vector: str = "embedding",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Exact cosine top ``k`` for any number of query vectors; see :class:`VectorSearch`.

    Vectors that travel with the plan, be they queries or pivots, take ``block_bytes`` at most.
    """
    return VectorSearch(vectors, queries, k, doc_id, vector, block_bytes).results()


def fuse(keyword: DataFrame, vector: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists per query."""
    a = keyword.select("query_id", "doc_id", F.col("rank").alias("keyword_rank"))
    b = vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "doc_id"], "full").withColumn(
        "score", F.round(part("keyword_rank") + part("vector_rank"), 9)
    )
    return top_k(fused, k)
