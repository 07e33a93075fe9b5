"""Quality rules by weak supervision, in DataFrame operations alone.

Each rule votes good or bad or abstains. Expectation-maximisation over the whole corpus estimates, without labels, how
often each rule votes and how often it is right in each class; a row's posterior probability of being good, not an
all-must-pass filter, decides. Rows enter the estimate as counts of vote patterns, of which there are at most three to
the power of the number of rules whatever the size of the corpus; only these counts reach the driver, and each row's
posterior is computed from its votes by an expression. What is supposed of the rules before any row is seen weighs as
much as WEIGHT rows, however many there are: it says which class is the good one, and the rows say the rest.

Defined cases: null and empty texts have no words and fail the base rules; a null doc_id is judged like any other; an
empty table gives an empty result; rows that repeat count as often as they stand; texts of any length are counted whole;
a posterior of exactly KEEP keeps; columns beyond doc_id and text are ignored. Word windows are compared by a 64-bit
hash within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: The six white-space characters between words, and the symbols that are counted.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Marks of any kind, symbols included.
MARKS = SYMBOLS + "!\"'()+,-./:;=?@[\\]^_`{}~"
#: Posterior from which a row is kept, the supposed share of good rows, rounds, and the suppositions' weight in rows.
KEEP, PRIOR, ROUNDS, WEIGHT = 0.5, 0.85, 100, 20


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select("doc_id", text.alias("t"), F.translate(text, SPACE, " " * len(SPACE)).alias("flat"))
    words = F.array_remove(F.split("flat", " "), "")
    split = flat.select(
        "doc_id",
        words.alias("w"),
        F.length(F.translate("flat", " ", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", MARKS, ""))).cast("long").alias("n_marks"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
    )
    n = F.size("w")
    # hashes of 3-word windows with their places, in order of hash: equal windows are neighbours
    window = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.col("w")[i + 1], F.col("w")[i + 2]).alias("h"), i.alias("i")))
    hashed = split.select(
        "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_marks", "n_upper", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.array_sort(window).alias("s"),
    )
    last = F.size("s") - 1
    again = F.filter("s", lambda x, j: ((j > 0) & (F.col("s")[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < last) & (F.col("s")[F.least(j + 1, last)]["h"] == x["h"])))
    few = F.size(F.array_distinct(F.transform("s", lambda x: x["h"]))) == F.size("s")
    marked = hashed.withColumn("at", F.when(few, F.array().cast("array<int>")).otherwise(F.array_sort(F.transform(again, lambda x: x["i"])))).drop("s")
    # places in order: each window adds the words that the next one doesn't cover, the last one all three
    covered = F.aggregate(F.transform("at", lambda x, j: F.when(j < F.size("at") - 1, F.least(F.col("at")[F.least(j + 1, F.size("at") - 1)] - x, F.lit(3))).otherwise(3)), F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_marks", "n_upper", "n_lines", "n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes -1 (bad) where ``bad`` holds, else 1 (good) where ``good`` does, else 0 (abstains)."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.coalesce(F.when(self.bad, -1).when(self.good, 1), F.lit(0))


def rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda c, of: F.col(c) / of
    lines, enough = F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_words") >= 30
    symbols, marks, upper = share("n_symbols", words), share("n_marks", words), share("n_upper", chars)
    repeats, distinct, again, size = share("n_repeat_words", words), share("n_distinct", words), share("n_dup_lines", lines), share("word_chars", words)
    # between the two signs a rule abstains; few words are no sign of good text
    return [
        Rule("symbols", enough & (symbols < 0.02), symbols > 0.15),
        Rule("marks", enough & (marks < 0.35), marks > 0.7),
        Rule("upper", enough & (upper < 0.06), upper > 0.4),
        Rule("repeats", enough & (repeats < 0.05), repeats > 0.4),
        Rule("distinct", enough & (distinct > 0.5), enough & (distinct < 0.25)),
        Rule("lines", (F.col("n_lines") >= 4) & (F.col("n_dup_lines") == 0), again > 0.4),
        Rule("word_size", size.between(4, 6), ~size.between(3, 6.6)),
    ]


#: What is supposed of every rule before any row is seen: probabilities of the votes bad, abstain, good in good and bad rows.
GOOD, BAD = (0.02, 0.28, 0.7), (0.4, 0.35, 0.25)


@dataclass
class Estimate:
    """P(good), and for each rule the probabilities of the votes bad, abstain, good in each class."""

    prior: float
    good: list[tuple[float, float, float]]
    bad: list[tuple[float, float, float]]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v + 1] / b[v + 1]) for v, g, b in zip(votes, self.good, self.bad, strict=True))

    def accuracies(self) -> list[float]:
        """How often each rule is right where it votes."""
        out = []
        for g, b in zip(self.good, self.bad, strict=True):
            right, voted = self.prior * g[2] + (1 - self.prior) * b[0], self.prior * (g[0] + g[2]) + (1 - self.prior) * (b[0] + b[2])
            out.append(right / voted)
        return out


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation on counts of vote patterns, from what is supposed of every rule, which keeps its weight."""
    e = Estimate(PRIOR, [GOOD] * n_rules, [BAD] * n_rules)
    total = sum(patterns.values())
    held = WEIGHT
    for _ in range(rounds):
        good = 0.0
        votes = [[[held * (1 - PRIOR) * x for x in BAD] for _ in range(n_rules)], [[held * PRIOR * x for x in GOOD] for _ in range(n_rules)]]
        for pattern, count in sorted(patterns.items()):
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, e.log_odds(pattern)))))
            good += count * p
            for r, v in enumerate(pattern):
                votes[0][r][v + 1] += count * (1 - p)
                votes[1][r][v + 1] += count * p
        share = lambda xs: tuple(x / sum(xs) for x in xs)
        e = Estimate((good + held * PRIOR) / (total + held), [share(x) for x in votes[1]], [share(x) for x in votes[0]])
    return e


def posterior(e: Estimate, votes: list[Column]) -> Column:
    """A row's probability of being good, from its votes."""
    odds = F.lit(math.log(e.prior / (1 - e.prior)))
    for v, g, b in zip(votes, e.good, e.bad, strict=True):
        at = [math.log(g[i] / b[i]) for i in range(3)]
        odds = odds + F.when(v == -1, at[0]).when(v == 0, at[1]).otherwise(at[2])
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, the four counts, base_failed, posterior, kept."""
    scratch = Scratch(docs.sparkSession)
    own = rules()
    names = [f"vote_{r.name}" for r in own]
    counts = scratch.table(measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), *[r.vote().cast("byte").alias(n) for r, n in zip(own, names, strict=True)]))
    found = counts.groupBy(*names).agg(F.count("*").alias("n")).collect()
    e = estimate({tuple(int(r[n]) for n in names): r["n"] for r in found}, len(own))
    p = posterior(e, [F.col(n) for n in names])
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", p.alias("posterior"), (~F.col("base_failed") & (p >= KEEP)).alias("kept"))


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
