"""Quality by a sparse ensemble of rules over text statistics.

Small regression trees are grown by boosting; every path from a root to a node is a
conjunctive rule. A lasso logistic fit (proximal gradient) gives most rules a weight
of zero; the rest are compiled into one Spark column over the statistics, which are
Spark columns over the text. Scoring runs no Python and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import lowest

SYMBOLS = "$%&*#@^~<>{}[]=+\\/_|"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PREFIX = "_stat_"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name. Null reads as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    size = F.length(t)
    words = F.split(t, "\\s+")
    lines = F.split(t, "\n")

    def of(signs: str) -> Column:
        return F.length(t) - F.length(F.translate(t, signs, ""))

    per_char = {"upper": of(_UPPER), "symbols": of(SYMBOLS), "bars": of("|"), "marks": of("!?"), "stops": of(".,;:"),
                "digits": of("0123456789"), "spaces": of(" \t\n\r")}
    out = {name: n / F.greatest(size, F.lit(1)) for name, n in per_char.items()}
    out["chars"] = size.cast("double")
    out["words"] = F.size(words).cast("double")
    out["new_words"] = F.size(F.array_distinct(words)) / F.size(words)
    out["new_lines"] = F.size(F.array_distinct(lines)) / F.size(lines)
    out["line_words"] = F.size(words) / F.size(lines)
    return out


NAMES = list(("upper", "symbols", "bars", "marks", "stops", "digits", "spaces", "chars", "words", "new_words", "new_lines", "line_words"))


@dataclass
class Rule:
    """A conjunction of (statistic, is above, threshold), and its weight in the log odds."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self, column: dict[str, Column]) -> Column:
        """The probability of label 1 as a column over statistics."""
        odds: Column = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, threshold in rule.terms:
                holds = holds & ((column[name] > threshold) if above else (column[name] <= threshold))
            odds = odds + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _grow(values: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[np.ndarray, list]:
    """Newton steps of one tree per row, and the terms of each of its nodes but the root."""
    step, paths = np.zeros(len(slope)), []

    def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + 1.0)

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = slope[rows], curve[rows]
        best = (1e-6, -1, 0.0)
        if left and len(rows) >= 2 * least:
            for f, at in enumerate(cuts):
                if not len(at):
                    continue
                bins = np.searchsorted(at, values[rows, f], side="left")  # bin i: above i thresholds
                sums = [np.bincount(bins, w, len(at) + 1).cumsum()[:-1] for w in (g, h)]
                count = np.bincount(bins, minlength=len(at) + 1).cumsum()[:-1]
                won = gain(*sums) + gain(g.sum() - sums[0], h.sum() - sums[1]) - gain(g.sum(), h.sum())
                won[(count < least) | (len(rows) - count < least)] = -1
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (float(won[k]), f, float(at[k]))
        _, f, threshold = best
        if f < 0:
            step[rows] = -g.sum() / (h.sum() + 1.0)
            return
        above = values[rows, f] > threshold
        for side, some in ((False, rows[~above]), (True, rows[above])):
            path = (*terms, (f, side, threshold))
            paths.append(path)
            split(some, path, left - 1)

    split(np.arange(len(slope)), (), depth)
    return step, paths


def fit(values: np.ndarray, labels: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4,
        bins: int = 64, least: int = 20, rounds: int = 600) -> Ensemble:
    """Rules for label 1 from statistics (rows, len(NAMES)); one class alone, or no rows, gives the bias only."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1.0)
    model = Ensemble(float(np.log(share / (1 - share))))
    if n == 0:
        return Ensemble(0.0)
    if labels.min() == labels.max():
        return model
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(values.shape[1])]
    odds, paths = np.full(n, model.bias), {}
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        step, found = _grow(values, chance - labels, chance * (1 - chance), cuts, depth, least)
        odds += rate * step
        for path in found:
            paths[tuple(sorted(path))] = path
    holds = np.ones((n, len(paths)), np.float32)
    for k, path in enumerate(paths.values()):
        for f, above, threshold in path:
            holds[:, k] *= (values[:, f] > threshold) == above
    scale = np.maximum(holds.std(axis=0), 1e-3)
    x = holds / scale
    x -= x.mean(axis=0)
    weight, ahead, bias, pace = np.zeros(len(paths)), np.zeros(len(paths)), model.bias, 1.0
    bound = 0.25 * float(np.linalg.eigvalsh((x.T @ x / n).astype(float)).max()) + 1e-9
    for _ in range(rounds):  # accelerated proximal gradient
        chance = 1 / (1 + np.exp(-(x @ ahead + bias)))
        bias -= 2.0 * float((chance - labels).mean())
        moved = ahead - x.T @ (chance - labels) / n / bound
        now = np.sign(moved) * np.maximum(np.abs(moved) - penalty / bound, 0)
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = now + (pace - 1) / following * (now - weight)
        weight, pace = now, following
    model.bias = float(bias - (weight / scale) @ holds.mean(axis=0))
    for w, path in zip(weight / scale, paths.values()):
        if abs(w) > 1e-6:
            model.rules.append(Rule(tuple((NAMES[f], bool(above), float(t)) for f, above, t in path), float(w)))
    return model


def with_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics): one pass over the texts. Null keys and repeated rows pass through."""
    found = statistics(F.col(text))
    return documents.select(F.col(key).alias("key"), *(found[n].alias(_PREFIX + n) for n in NAMES))


def learn(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = 20_000) -> Ensemble:
    """Fit on the labelled rows of a table of statistics, at most ``sample`` of them, those whose hash of the key is least.

    Rows with a null key or label teach nothing; of several labels for a key the greatest counts.
    A count of the labels tells below which hash rows are taken, so a little more than the sample is all that is brought together.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("_label"))
    rows = table.join(lowest(known, "key", sample), "key").orderBy(F.xxhash64("key"), "key").limit(sample)
    got = rows.select(*(_PREFIX + n for n in NAMES), F.col("_label").cast("double")).toPandas().to_numpy(float)
    return fit(got[:, :-1], got[:, -1] if len(got) else np.zeros(0))


def scored(table: DataFrame, model: Ensemble) -> DataFrame:
    """(key, score, predicted) for a table of statistics."""
    score = model.score({n: F.col(_PREFIX + n) for n in NAMES})
    return table.select("key", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(documents: DataFrame, model: Ensemble, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more. Nothing is joined by key."""
    held = "_kept_statistics"
    while held in documents.columns:
        held += "_"
    found = statistics(F.col(text))
    # A generator of one row: the filter is not pushed below it, which would compute the statistics anew for each rule.
    once = F.explode(F.array(F.struct(*(found[n].alias(n) for n in NAMES)))).alias(held)
    rows = documents.select("*", once)
    return rows.where(model.score({n: F.col(held)[n] for n in NAMES}) >= least).drop(held)
