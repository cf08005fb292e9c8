"""Quality by weak supervision: rules vote or abstain, and no rule decides alone.

Every rule calls a text good or bad, or abstains, from a few measures of it. How often each rule
votes so on good and on bad texts is not told but estimated, by expectation
maximisation over the votes of all documents, and a document is kept if the
posterior probability that it is good is one half at least. Votes are counted
per pattern first, so a step costs as much as there are patterns (three to the number of
rules at most), however many documents there are.

Measures, votes and posterior are Spark columns; the texts are read once and no Python sees a row of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYMBOL = "[#*$%&|<>]"
_WORD = "[^\\x20\\x09-\\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEWEST_WORDS, MOST_REPEATED = 50, 50  # words; hundredths of them
_BELIEF = 0.02  # the share of all documents that the opening assumptions count as, in each class


@dataclass(frozen=True)
class Rule:
    """Votes bad above or below one bound of a measure, good on the other side of a second bound, and abstains between."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        """1 for good, -1 for bad, 0 for neither."""
        at = F.col(self.measure)
        if self.good < self.bad:
            return F.when(at <= self.good, 1).when(at >= self.bad, -1).otherwise(0)
        return F.when(at >= self.good, 1).when(at <= self.bad, -1).otherwise(0)


#: What prose and junk look like, whatever the language.
RULES = (
    Rule("symbols", "symbol_share", 0.02, 0.10),
    Rule("capitals", "capital_share", 0.15, 0.40),
    Rule("shouts", "shouts_per_word", 0.05, 0.30),
    Rule("bars", "bars_per_word", 0.01, 0.20),
    Rule("repeats", "repeat_share", 0.10, 0.40),
    Rule("variety", "variety", 3.0, 1.2),
    Rule("lines", "dup_line_share", 0.05, 0.30),
    Rule("plain_words", "plain_share", 0.80, 0.60),
    Rule("marks", "mark_share", 0.06, 0.12),
    Rule("little_words", "little_share", 0.10, 0.02),
)
#: The commonest words of English, Spanish, German and French prose.
LITTLE_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "on", "by", "be", "a", "de", "la", "que", "el", "en", "los", "se",
                "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "y", "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des",
                "auf", "ist", "im", "dem", "nicht", "ein", "eine", "le", "les", "et", "une", "du", "dans", "qui", "pour", "pas", "au", "sur", "ce")
_PLAIN = "^\\p{L}+[.,;:!?]?$"


def counted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS..., measures of the rules): whole texts, one row per row. Null reads as empty; extra columns are left out.

    A window of three words is found twice if a sort of the text's windows puts two equal ones side by side.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = documents.select(F.col(key).alias("key"), t.alias("_t"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("_w"),
                            F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(_WORD))).alias("_l"))
    word = lambda i: F.get("_w", i)
    places = F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = base.withColumn("_h", F.transform(places, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    windows = F.transform("_h", lambda h, i: F.struct(h.alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i")))
    # Most texts have no window twice, and a set of hashes tells; only the others are sorted.
    doubled = F.size(F.array_distinct("_h")) < F.size("_h")
    ordered = hashed.withColumn("_s", F.when(doubled, F.sort_array(windows)))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = F.filter("_s", lambda x, k: (
        F.coalesce((k > 0) & same(x, F.get("_s", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_s", k + 1)), F.lit(False))))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    held = lambda signs: F.regexp_count("_t", F.lit(signs))
    rows = ordered.select(
        "key", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), held(_SYMBOL).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_s").isNotNull(), F.size(F.array_distinct(covered))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"), F.size(F.array_distinct("_w")).alias("_distinct"), held("[A-Z]").alias("_upper"),
        held("[!?]").alias("_shouts"), held("[|]").alias("_bars"), held("[^\\p{L}\\p{N}\\p{M}\\s]").alias("_marks"),
        F.size(F.filter("_w", lambda w: F.rlike(w, F.lit(_PLAIN)))).alias("_plain"), F.size(F.filter("_w", lambda w: w.isin(*LITTLE_WORDS))).alias("_little"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        "key", *COUNTS, share("n_symbols", "word_chars").alias("symbol_share"),
        share("_upper", "word_chars").alias("capital_share"), share("_shouts", "n_words").alias("shouts_per_word"),
        share("_bars", "n_words").alias("bars_per_word"), share("n_repeat_words", "n_words").alias("repeat_share"),
        (F.col("_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))).alias("variety"), share("n_dup_lines", "_lines").alias("dup_line_share"),
        share("_plain", "n_words").alias("plain_share"), share("_marks", "word_chars").alias("mark_share"), share("_little", "n_words").alias("little_share"))


def voted(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, COUNTS..., votes array<int>): a vote of each rule in order."""
    return measured.select("key", *COUNTS, F.array(*(r.vote() for r in rules)).alias("votes"))


@dataclass
class Accuracies:
    """``prior``: share of good documents; ``chance[class][rule][vote + 1]``, class 1 the good one."""

    prior: float
    chance: list[list[list[float]]]

    def odds(self, votes: Column) -> Column:
        """Log odds that a document with these votes is good."""
        found: Column = F.lit(math.log(self.prior / (1 - self.prior)))
        for k in range(len(self.chance[0])):
            weights = [math.log(self.chance[1][k][v] / self.chance[0][k][v]) for v in range(3)]
            found = found + F.get(F.array(*map(F.lit, weights)), F.get(votes, F.lit(k)) + 1)
        return found


#: Before the first step rules are taken to be right more often than not, and bad documents to be caught by some rules only.
_OPENING = ([0.200, 0.050, 0.750], [0.002, 0.048, 0.950])


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100, prior: float = 0.85) -> Accuracies:
    """Expectation maximisation over (votes, number of documents). Without documents the opening assumptions stay.

    Every class is taken to have seen a little of its opening behaviour, so no chance is nought, and a rule
    that never votes one way says little about it.
    """
    model = Accuracies(prior, [[list(kind) for _ in range(n_rules)] for kind in _OPENING])
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        seen = [[[_BELIEF * total * p for p in kind] for _ in range(n_rules)] for kind in _OPENING]
        good = 0.0
        for votes, n in patterns:
            odds = math.log(model.prior / (1 - model.prior)) + sum(math.log(model.chance[1][k][v + 1] / model.chance[0][k][v + 1]) for k, v in enumerate(votes))
            chance = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good += n * chance
            for k, v in enumerate(votes):
                seen[1][k][v + 1] += n * chance
                seen[0][k][v + 1] += n * (1 - chance)
        before = model.prior
        model = Accuracies(min(max(good / total, 1e-6), 1 - 1e-6), [[[x / sum(row) for x in row] for row in kind] for kind in seen])
        if abs(model.prior - before) < 1e-9:
            break
    return model


def learn(table: DataFrame, n_rules: int = len(RULES)) -> Accuracies:
    """From the votes of all documents. What comes to the driver is one row for each pattern of votes."""
    found = table.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate(sorted((tuple(r.votes), r.n) for r in found), n_rules)


def judged(table: DataFrame, model: Accuracies, least: float = 0.5) -> DataFrame:
    """(key, COUNTS..., base_failed, posterior, kept) of voted documents: the verdict is the posterior's, but texts that fail the base rules are never kept."""
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-model.odds(F.col("votes"))))
    rows = table.select("key", *COUNTS, failed.alias("base_failed"), posterior.alias("posterior"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
