"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes good (1), bad (0) or abstains (null). The vote patterns are counted
over all documents that pass the base (at most 3 to the number of rules, whatever the number of documents);
expectation-maximisation over these counts estimates, for each rule, how often it votes bad on bad and on good
documents, and the share of good documents. A document's posterior log-odds of being good is then a sum of one
constant for each vote, so the verdict is a column expression. A text that fails the base (too few words, too much
repetition) is out whatever the posterior.

The estimates are free: one pseudo-vote each way keeps logarithms finite, and nothing else bounds them. Which class is
the good one is settled by the start (the share of a document's votes that are good) and, should the classes have
changed places, by turning them round: on the whole, rules vote bad more often on bad documents. No single vote
rejects by itself unless its rule has shown to be that accurate: a bad vote of a rule that also fires on documents
that all other rules call good weighs little.

Defined results: null text has no words: all counts 0, base failed, not kept; an empty text likewise; an empty table
gives an empty table; repeated rows get equal results; documents with equal votes get equal posteriors; extra columns
are ignored by `scores` and kept by `filter_documents`, whose own columns carry a prefix that makes way for columns of
the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm._common import bind, free_prefix, named, words, written

# Characters of the contract's symbol count.
SYMBOLS = "[^#*$%&|<>]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_distinct", "n_letters", "n_upper", "n_stops")
RULES = ("symbols", "letters", "word_length", "line_ends", "distinct", "line_repeats", "word_repeats", "capitals", "sentences", "length")
ROUNDS = 50
KEEP = 0.5


def repeat_words(w: Column) -> Column:
    """Words covered by 5-word windows that occur at least twice in the word array."""
    empty = F.array().cast("array<bigint>")
    hashes = bind(w, lambda a: F.when(F.size(a) < 5, empty).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(5))))))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bind(by_hash, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        steps = bind(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def counts(text: Column) -> dict[str, Column]:
    """The counts the rules look at, in the order of COUNTS."""
    text = F.coalesce(text, F.lit(""))
    length = lambda keep: F.char_length(F.regexp_replace(text, keep, "")).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    of_words = bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct")
        ),
    )
    of_lines = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"), F.size(F.filter(x, lambda y: y.rlike(r"[.!?][ \t\n\x0B\f\r]*\z"))).cast("bigint").alias("n_ended")
        ),
    )
    return {"of_words": of_words, "of_lines": of_lines, "n_symbols": length(SYMBOLS), "n_letters": length(r"\P{L}+"), "n_upper": length("[^A-ZÀ-ÖØ-Þ]+"), "n_stops": length("[^.!?。！？]+")}


def with_counts(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df with the columns of COUNTS (after the prefix) and base_failed."""
    p = prefix
    found = counts(named(text_col))
    of = {"n_words": "of_words", "word_chars": "of_words", "n_repeat_words": "of_words", "n_distinct": "of_words", "n_lines": "of_lines", "n_dup_lines": "of_lines", "n_ended": "of_lines"}
    raw = df.withColumns({f"{p}__{k}": c for k, c in found.items()})
    out = raw.withColumns({f"{p}{k}": F.col(f"{p}__{of[k]}.{k}" if k in of else f"{p}__{k}") for k in COUNTS}).drop(*(f"{p}__{k}" for k in found))
    n, r = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    return out.withColumn(f"{p}base_failed", (n < 10) | (100 * r > 20 * n))


def votes(prefix: str = "") -> dict[str, Column]:
    """One column for each rule: 1 good, 0 bad, null abstains."""
    c = {k: F.col(f"{prefix}{k}") for k in COUNTS}
    n, chars = c["n_words"], c["word_chars"]
    vote = lambda bad, good: F.when(bad, 0).when(good, 1)
    return {
        "symbols": vote(10 * c["n_symbols"] > n, 50 * c["n_symbols"] <= n),
        "letters": vote(100 * c["n_letters"] < 92 * chars, 100 * c["n_letters"] > 95 * chars),
        "word_length": vote((10 * chars < 44 * n) | (10 * chars > 65 * n), (10 * chars >= 47 * n) & (10 * chars <= 60 * n)),
        "line_ends": vote(100 * c["n_ended"] < 95 * c["n_lines"], 100 * c["n_ended"] >= 99 * c["n_lines"]),
        "distinct": vote(10 * c["n_distinct"] < 6 * n, 10 * c["n_distinct"] > 7 * n),
        "line_repeats": vote(10 * c["n_dup_lines"] > c["n_lines"], c["n_dup_lines"] == 0),
        "word_repeats": vote(20 * c["n_repeat_words"] > n, 100 * c["n_repeat_words"] <= n),
        "capitals": vote(10 * c["n_upper"] > chars, 25 * c["n_upper"] < chars),
        "sentences": vote(25 * c["n_stops"] < n, 20 * c["n_stops"] > n),
        "length": vote(n < 20, n >= 50),
    }


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns and their counts: share of good, and for each rule P(bad vote | bad), P(bad vote | good).

    Both probabilities are of a vote that is cast, with one pseudo-vote for and against.
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    if not patterns:
        return 0.5, [(0.5, 0.5)] * k
    share = [start(v) for v, _ in patterns]
    for _ in range(rounds):
        good = (sum(s * m for s, (_, m) in zip(share, patterns, strict=True)) + 1) / (sum(m for _, m in patterns) + 2)
        rules = []
        for j in range(k):
            cast = [(s, v[j], m) for s, (v, m) in zip(share, patterns, strict=True) if v[j] is not None]
            bad = (sum((1 - s) * m for s, x, m in cast if x == 0) + 1) / (sum((1 - s) * m for s, _, m in cast) + 2)
            false = (sum(s * m for s, x, m in cast if x == 0) + 1) / (sum(s * m for s, _, m in cast) + 2)
            rules.append((bad, false))
        share = [posterior(good, rules, v) for v, _ in patterns]
    if sum(b - g for b, g in rules) < 0:  # the classes have changed places
        return 1 - good, [(g, b) for b, g in rules]
    return good, rules


def start(vote: tuple[int | None, ...]) -> float:
    """The first guess: the cube of the share of good votes among those cast, within 0.02 and 0.98."""
    cast = [v for v in vote if v is not None]
    return min(0.98, max(0.02, (sum(cast) / len(cast)) ** 3 if cast else 1.0))


def weights(good: float, rules: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log-odds of good: the prior's, and for each rule those of a bad and of a good vote."""
    return math.log(good / (1 - good)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for b, g in rules]


def posterior(good: float, rules: list[tuple[float, float]], vote: tuple[int | None, ...]) -> float:
    at, each = weights(good, rules)
    return 1 / (1 + math.exp(min(700.0, -(at + sum(w[v] for w, v in zip(each, vote, strict=True) if v is not None)))))


def fit_votes(df: DataFrame, prefix: str = "") -> tuple[float, list[tuple[float, float]]]:
    """Count the vote patterns over all rows of df (with counts) that pass the base, and fit.

    At most 3 ** len(RULES) rows are collected.
    """
    cols = [v.alias(k) for k, v in votes(prefix).items()]
    rows = df.filter(~F.col(f"{prefix}base_failed")).select(*cols).groupBy(*RULES).count().collect()
    return fit(sorted(((tuple(r[k] for k in RULES), r["count"]) for r in rows), key=str))


def posterior_column(model: tuple[float, list[tuple[float, float]]], prefix: str = "") -> Column:
    at, each = weights(*model)
    odds = F.lit(at)
    for (_, vote), (bad, good) in zip(votes(prefix).items(), each, strict=True):
        odds = odds + F.when(vote == 0, bad).when(vote == 1, good).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def scores(df: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior, kept. One pass over the texts; the counts are kept in a small table."""
    counted = written(with_counts(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    model = fit_votes(counted)
    return counted.withColumn("posterior", posterior_column(model)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def filter_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that the method keeps, with df's columns."""
    p = free_prefix(df.columns, "__q")
    counted = written(with_counts(df, text_col, p))
    model = fit_votes(counted, p)
    return counted.filter(~F.col(f"{p}base_failed") & (posterior_column(model, p) >= KEEP)).select(*(named(c) for c in df.columns))
