"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at a few counts of a document and votes bad (-1), good (+1) or abstains (0). Rules vote
one way only. A latent class model has the share of good documents and for each rule its chance to vote in
either class, under one constraint: a bad-voting rule votes on bad documents at least as often as on good
ones, a good-voting rule the other way round, so no bad vote ever speaks for a document. Expectation
maximisation fits that model to the documents that pass the base rules; where the two chances of a rule
would break their order they are pooled, which is the constrained maximum. A document stays where the
fitted posterior probability of good quality is at least 1/2.

All of it is DataFrame operations. The table of vote patterns that EM runs on has at most
2 ** len(RULES) rows, whatever the number of documents; one row of sums comes back per iteration.

Defined results: a null text has no words and, with under 50 words, fails; empty tables give empty
results; repeated rows are judged alike, also those of a null doc_id; texts of any length are
counted whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import documents, fresh, small, whole_text, write_shared

SPACE = "\\x20\\x09-\\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A window's position has this many bits beside the high bits of its hash.
POSITION_BITS = 24
#: EM ends after so many rounds, or when no chance changes by SETTLED.
ITERATIONS = 15
SETTLED = 1e-6
#: EM starts with these chances to vote on a (good, bad) document, for bad-voting and good-voting rules.
START = {-1: (0.01, 0.3), 1: (0.6, 0.3)}
#: Prior observations as a share of the documents, at the chances of START and a share of 0.8 good ones.
PRIOR_WEIGHT = 0.01
KEEP_FROM = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas in ``body`` use it."""
    return F.transform(F.array(value), body)[0]


def covered_words(tri: Column) -> Column:
    """Words in 3-word windows that occur twice or more, from the windows' hashes in order.

    Windows are sorted by (hash, position); those equal to a neighbour repeat. The sort goes by the high bits of
    the hash and the position, packed into a long. Where that could tear equal hashes apart, because two
    different ones share their high bits or the positions don't fit, whole hashes are sorted instead.
    """
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")

    def position(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def repeated(packed: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            y = F.get(packed, k)
            return F.coalesce(F.get(tri, position(x)) == F.get(tri, position(y)), F.lit(False))

        def torn(x: Column, k: Column) -> Column:
            before = F.get(packed, k - 1)
            return (F.shiftright(x, POSITION_BITS) == F.shiftright(before, POSITION_BITS)) & ~same(x, k - 1)

        found = F.transform(F.filter(packed, lambda x, k: same(x, k - 1) | same(x, k + 1)), position)
        clean = F.size(F.filter(packed, torn)) == 0
        return F.when(clean, found).otherwise(let(pairs, repeated_pairs))

    def repeated_pairs(pairs: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(x["h"] == F.get(pairs, k)["h"], F.lit(False))

        return F.transform(F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    high = F.lit(-(1 << POSITION_BITS)).cast("long")
    packed = F.sort_array(F.transform(tri, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.when(F.size(tri) <= (1 << POSITION_BITS), let(packed, repeated)).otherwise(let(pairs, repeated_pairs))
    step = F.aggregate(
        F.sort_array(at),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
    )
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0).cast("long")).otherwise(step["n"])


def text_counts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The counts that rules read, one row for each row of ``df``."""
    body = whole_text(text)
    with_words = df.select(
        F.col(key).alias("doc_id"),
        F.xxhash64(body).alias("text_key"),
        body.alias("body"),
        F.filter(F.split(body, f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    words, n = F.col("words"), F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def without(chars: str) -> Column:
        return F.length(F.translate("body", chars, "")).cast("long")

    length = F.length("body").cast("long")
    return with_words.select(
        "doc_id",
        "text_key",
        n.cast("long").alias("n_words"),
        without(SPACES).alias("word_chars"),
        (length - without(SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(windows, covered_words).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        (length - F.length(F.regexp_replace("body", "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (length - without("!?")).alias("n_marks"),
        F.length(F.regexp_replace("body", "[^\\p{L}\\p{N}]+", "")).cast("long").alias("n_alnum"),
    )


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: (vote, when it is given): the rule abstains on other documents.
RULES: dict[str, tuple[int, Callable[[], Column]]] = {
    "symbols": (-1, lambda: _share("n_symbols", "n_words") > 0.1),
    "capitals": (-1, lambda: (_share("n_upper", "word_chars") > 0.3) & (F.col("n_words") >= 10)),
    "marks": (-1, lambda: _share("n_marks", "n_words") > 0.5),
    "repeats": (-1, lambda: _share("n_repeat_words", "n_words") > 0.3),
    "same_lines": (-1, lambda: _share("n_dup_lines", "n_lines") > 0.4),
    "word_length": (
        -1,
        lambda: (_share("word_chars", "n_words") < 2.5) | (_share("word_chars", "n_words") > 14),
    ),
    "alnum": (1, lambda: _share("n_alnum", "word_chars") > 0.9),
    "varied": (1, lambda: _share("n_distinct_words", "n_words") > 0.3),
}


def vote(counts: DataFrame) -> DataFrame:
    """``counts`` with a column vote_<rule> of -1, 0 or 1 for each rule."""
    votes = (F.when(given(), way).otherwise(0).cast("int").alias(f"vote_{x}") for x, (way, given) in RULES.items())
    return counts.select("*", *votes)


#: The chances of each rule to vote on a good and on a bad document.
Model = dict[str, tuple[float, float]]


def posterior(model: Model, share_good: float) -> Column:
    """The probability of good quality from the vote columns."""
    logit = F.lit(math.log(share_good / (1 - share_good)))
    for name, (good, bad) in model.items():
        logit = logit + F.when(F.col(f"vote_{name}") != 0, math.log(good / bad)).otherwise(math.log((1 - good) / (1 - bad)))
    return 1 / (1 + F.exp(-logit))


def chances(way: int, good: tuple[float, float], bad: tuple[float, float]) -> tuple[float, float]:
    """A rule's chances from (votes, documents) of either class, pooled where they break their order."""
    both = tuple(min(0.999, max(1e-4, hits / of)) for hits, of in (good, bad))
    if way * (both[0] - both[1]) < 0:
        both = (min(0.999, max(1e-4, (good[0] + bad[0]) / (good[1] + bad[1]))),) * 2
    return both


def fit(votes: DataFrame, iterations: int = ITERATIONS) -> tuple[Model, float]:
    """Rule chances and the share of good documents by EM over the table of vote patterns."""
    patterns = write_shared(
        votes.groupBy(*(f"vote_{x}" for x in RULES)).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns"
    )
    model: Model = {x: START[way] for x, (way, _) in RULES.items()}
    share_good = 0.8
    p, n = F.col("p"), F.col("n")
    sums = {"good": F.sum(n * p), "bad": F.sum(n * (1 - p))}
    for x in RULES:
        for side, share in (("good", p), ("bad", 1 - p)):
            sums[f"{x}_{side}"] = F.sum(F.when(F.col(f"vote_{x}") != 0, n * share).otherwise(0.0))
    for _ in range(iterations):
        s = patterns.withColumn("p", posterior(model, share_good)).agg(*(c.alias(k) for k, c in sums.items())).first()
        if s["good"] is None:
            break
        extra = 1 + PRIOR_WEIGHT * (s["good"] + s["bad"])
        before, model = model, {}
        for x, (way, _) in RULES.items():
            sides = zip(("good", "bad"), START[way], strict=True)
            model[x] = chances(way, *((s[f"{x}_{side}"] + extra * start, s[side] + extra) for side, start in sides))
        share_good = (s["good"] + 0.8 * extra) / (s["good"] + s["bad"] + extra)
        if max(abs(a - b) for x in RULES for a, b in zip(model[x], before[x], strict=True)) < SETTLED:
            break
    return model, share_good


def judge(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, votes, p_good, base_failed and kept for each row of ``df``."""
    votes = write_shared(vote(text_counts(df, text, key)), "quality-votes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model, share_good = fit(votes.where(~failed))
    return (
        votes.withColumn("p_good", posterior(model, share_good))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= KEEP_FROM))
    )


def filtered(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` without the documents that fail or are judged bad."""
    doc, own = fresh(df, "_doc"), fresh(df, "_key")
    gone = judge(df, text, key).where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("text_key").alias(own))
    gone = small(write_shared(gone.distinct(), "rejected"))
    same = F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(whole_text(text)) == F.col(own))
    return df.join(gone, same, "left_anti")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("p_good", 6).alias("p_good"),
    )
