"""Personal data by weak supervision (native Spark only).

Spans matched by the base patterns always stay. Looser candidates are judged: regex,
gazetteer and context labelers vote on every candidate (base ones too), expectation
maximisation estimates how reliable each labeler is without any labels, and the
resulting soft labels train a naive Bayes span classifier over features of the span
and its surroundings. Candidates it takes for personal data are added.

Nothing but counts per vote pattern and per feature value leaves the executors; both
are bounded by the number of labelers and features, whatever the corpus.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import keeps_columns, query, table, written

# Base patterns and limits. Possessive repeats and the look-behind
# change no match; they keep long runs of letters or digits linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ["email", "ip", "card", "phone"]
# Kinds of candidates beyond the base patterns, with their patterns.
EXTRA = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,24}\b",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "secret": r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\s]{4,}+|\bAKIA[0-9A-Z]{16}\b",
}
KINDS = [*BASE_KINDS, "ssn", "iban", "secret"]
# Gazetteers and cue words.
KNOWN_ENDINGS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us"
DUMMIES = r"localhost|127\.0\.0\.1|0\.0\.0\.0|255\.255\.255\.255|changeme|xxxx|noreply|123-45-6789|555-555-5555"
CUES = r"mail|contact|reach|write|call|phone|tel|mobile|fax|card|visa|pay|host|address|login|user|account|password|ssn|social|iban|bank"
COUNTER_CUES = r"version|release|isbn|issn|order|invoice|ticket|page|figure|section|total|price|[$€£#]"
CONTEXT = 32
ROUNDS = 12


def _spans(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """Matches as (start, rank, end, kind, value), code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rank = KINDS.index(kind)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
            F.lit(kind).alias("kind"), pair["value"].alias("value"),
        )
        return F.struct(end.alias("at"), F.array_append(state["found"], span).alias("found"))

    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>)")
    pairs = F.zip_with(
        matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("value"), g.alias("gap"))
    )
    first = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
    return F.when(guard, F.aggregate(pairs, first, step, lambda s: s["found"])).otherwise(nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(places, F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by start and kind; failing matches are dropped, not retried."""
    digits = lambda s: F.length(_digits(s["value"]))
    octets = lambda s: F.forall(
        F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    )
    email = _spans(text, EMAIL, "email", F.contains(text, F.lit("@")))
    ip = F.filter(_spans(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), octets)
    cards = _spans(text, CARD, "card", text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"))
    card = F.filter(cards, lambda s: digits(s).between(12, 19) & _luhn(s["value"]))
    phones = _spans(text, PHONE, "phone", F.contains(text, F.lit("+")))
    phone = F.filter(phones, lambda s: digits(s).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _extra_spans(text: Column, base: Column) -> Column:
    guards = {
        "email": text.rlike(r"(?i)(?:\(at\)|\[at\]|\x20at\x20)[^@]{1,70}?(?:\(dot\)|\[dot\]|\x20dot\x20)"),
        "phone": text.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"),
        "ssn": text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        "secret": text.rlike(r"[=:]|AKIA"),
    }
    found = F.concat(*[_spans(text, p, k, guards[k]) for k, p in EXTRA.items()])
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.array_sort(F.filter(found, apart))


def _judged(text: Column, spans: Column) -> Column:
    """Spans with the labelers' votes (1 personal, -1 not, 0 none) and the classifier's features."""

    def judge(s: Column) -> Column:
        value, kind = s["value"], s["kind"]
        left = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.lower(F.substring(text, left + 1, s["start"] - left))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        n_digits = F.length(_digits(value))
        vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
        shape = (
            F.when(kind == "email", value.rlike(r"(?i)[@)\]\x20][a-z0-9-]+.*[a-z]{2,}$"))
            .when(kind == "secret", value.rlike(r"[=:]\x20?(?=.*[0-9])[^\s]{6,}$|^AKIA[0-9A-Z]{16}$"))
            .when(kind == "ssn", ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"))
            .when(kind == "phone", n_digits.between(9, 15))
            .otherwise(n_digits >= 4)
        )
        alone = before.rlike(r"(?:^|[^\p{L}\p{N}])$") & ~after.rlike(r"[\p{L}\p{N}]")
        votes = F.array(
            vote(shape, ~shape),  # regex: strict shape
            vote(F.lit(False), _digits(value).rlike(r"^([0-9])\1{5,}$|^0123456|^123456789")),  # regex: filler
            vote(F.lower(value).rlike(rf"(?:[.\x20]|dot\)|dot\])\x20?(?:{KNOWN_ENDINGS})$|^(?:password|token|secret|api|akia)")),
            vote(F.lit(False), F.lower(value).rlike(DUMMIES)),  # gazetteer: dummies
            vote(before.rlike(CUES)),  # context: words that announce personal data
            vote(F.lit(False), before.rlike(COUNTER_CUES)),  # context: words that announce other numbers
            vote(alone, ~alone),  # context: stands alone
        )
        features = F.array(
            F.concat(F.lit("kind="), kind),
            F.concat(F.lit("length="), F.least(F.length(value) / 8, F.lit(8)).cast("int").cast("string")),
            F.concat(F.lit("digits="), (8 * n_digits / F.length(value)).cast("int").cast("string")),
            F.concat(F.lit("mark="), F.regexp_extract(before, r"([^\p{L}\p{N}\s])\x20?$", 1).isin(":", "=", "(", "<").cast("string")),
            F.concat(F.lit("cue="), before.rlike(CUES).cast("string"), before.rlike(COUNTER_CUES).cast("string")),
            F.concat(F.lit("edge="), alone.cast("string")),
        )
        return F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
            kind.alias("kind"), votes.alias("votes"), features.alias("features"),
        )

    return F.transform(spans, judge)


def _posterior(prior: float, rates: list[dict[int, tuple[float, float]]]) -> Column:
    """Probability of personal data given ``votes``; ``rates``: per labeler and vote, P(vote | yes), P(vote | no)."""
    # All weights stand in one array that votes index: the plan is the same in each round,
    # so its code is compiled once. The prior is shared out to the labelers.
    share = math.log(prior / (1 - prior)) / len(rates)
    weights = F.array(*[F.lit(math.log(r[v][0] / r[v][1]) + share) for r in rates for v in (-1, 0, 1)])
    return 1 / (1 + F.exp(-reduce(add, [weights[F.col("votes")[j] + 3 * j + 1] for j in range(len(rates))])))


def labeler_reliability(patterns: DataFrame, labelers: int, rounds: int = ROUNDS):
    """(prior, rates) by expectation maximisation over (votes, n), one small aggregate per round.

    A labeler starts as right in 4 of 5 votes; smoothing by one vote keeps all rates
    inside (0, 1).
    """
    prior = 0.5
    rates = [{1: (0.4, 0.1), -1: (0.1, 0.4), 0: (0.5, 0.5)} for _ in range(labelers)]
    for _ in range(rounds):
        soft = patterns.select("n", _posterior(prior, rates).alias("p"), F.posexplode("votes").alias("j", "vote"))
        found = (
            soft.groupBy("j", "vote")
            .agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
            .collect()
        )  # one row per labeler and vote
        if not found:
            break
        sums = {(r["j"], r["vote"]): (r["yes"], r["no"]) for r in found}
        # Every candidate has one vote of the first labeler.
        yes, no = (sum(sums.get((0, v), (0, 0))[i] for v in (1, -1, 0)) for i in (0, 1))
        prior = min(max((yes + 1) / (yes + no + 2), 1e-3), 1 - 1e-3)
        rates = [
            {
                v: tuple((x + 1) / (all_ + 3) for x, all_ in zip(sums.get((j, v), (0, 0)), (yes, no)))
                for v in (1, -1, 0)
            }
            for j in range(labelers)
        ]
    return prior, rates


def span_classifier(patterns: DataFrame, prior: float, rates) -> dict[str, float]:
    """Log ratio of every feature value, learned from soft labels; the key "" holds the prior's.

    ``patterns`` has (votes, features, n).
    """
    soft = patterns.select("features", "n", _posterior(prior, rates).alias("p"))
    rows = (
        soft.select("p", "n", F.explode(F.concat("features", F.array(F.lit("")))).alias("feature"))
        .groupBy("feature")
        .agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
        .collect()
    )  # one row per feature value: under a hundred
    total = next(((r["yes"] + 1, r["no"] + 1) for r in rows if r["feature"] == ""), (1.0, 1.0))
    weights = {
        r["feature"]: math.log((r["yes"] + 0.5) / (total[0] + 1)) - math.log((r["no"] + 0.5) / (total[1] + 1))
        for r in rows
    }
    return weights | {"": math.log(total[0] / total[1])}


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``_base`` and ``_spans``: arrays of (start, rank, end, kind), sorted.

    NULL texts count as empty and have none. Rows are kept as they are, repeated ones
    too; earlier columns of those names are replaced. Texts are cut once: the result is
    written to the shared folder with its candidates.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.drop("_base", "_spans", "_extra").withColumn("_base", base_spans(text))
    cut = base.withColumn("_extra", _judged(text, _extra_spans(text, F.col("_base"))))
    columns = [c for c in keep or docs.columns if c not in ("_base", "_spans", "_extra")]
    judged = cut.withColumn("_base", _judged(text, F.col("_base")))
    rows = written(judged.select(*[F.col(f"`{c}`") for c in columns], "_base", "_extra"), "spans")
    spans = F.explode(F.concat("_base", "_extra"))
    candidates = rows.select(spans.alias("s")).select("s.votes", "s.features")
    # Patterns of seven votes and few features: a small table that all rounds share.
    patterns = written(candidates.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")), "votes")
    prior, rates = labeler_reliability(patterns.groupBy("votes").agg(F.sum("n").alias("n")), 7)
    weights = span_classifier(patterns, prior, rates)
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    score = lambda s: F.aggregate(
        s["features"], F.lit(weights[""]), lambda a, f: a + F.coalesce(known[f], F.lit(0.0))
    )
    lean = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    kept = F.transform(F.filter("_extra", lambda s: score(s) > 0), lean)
    return rows.withColumn("_base", F.transform("_base", lean)).withColumn(
        "_spans", F.array_sort(F.concat("_base", kept))
    ).drop("_extra")


@keeps_columns("doc_id", "text", "n_chars")
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Spans that overlap are replaced together, under the kind of the first. NULL texts
    stay NULL; ``n_chars`` follows the new text where the column exists.
    """
    found = find_pii(docs)
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = s["start"] >= state["at"]
        tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, tag)).otherwise(state["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    clean = found.withColumn("text", F.when(F.size("_spans") > 0, F.aggregate("_spans", first, step, rest)).otherwise(text))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


@query("op2_pii")
def op2_pii(spark, folder):
    """Base counts and digest, and all spans, of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_pii(docs, ["doc_id"])
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
    )
