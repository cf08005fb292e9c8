"""Re-ranking by any model: a loader is given, the model is made once in a worker, and pairs reach it in Arrow batches.

A model is a function of two lists, questions and texts, that gives a number for each pair. What it is
does not show in the plan: a cross-encoder, a lookup or an overlap of words all run alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L
from lexmesh.operators.fusion import above_then_top

Model = Callable[[list[str], list[str]], list[float]]
_MODEL: list = [None, None]  # the model this worker made last, and its name


def scored(pairs: DataFrame, load: Callable[[], Model], question: str = "question", text: str = "text") -> DataFrame:
    """The pairs with the model's ``score`` in place of the two texts; null texts read as empty."""
    rest = [f for f in pairs.schema.fields if f.name not in (question, text, "score")]
    name = uuid.uuid4().hex

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _MODEL[1] != name:
            _MODEL[:] = load(), name
        model = _MODEL[0]
        for batch in batches:
            out = batch[[f.name for f in rest]].copy()
            out["score"] = [float(x) for x in model(batch[question].fillna("").tolist(), batch[text].fillna("").tolist())]
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "score double"])
    return pairs.select(*(f.name for f in rest), question, text).mapInPandas(ask, schema)


def rerank(pairs: DataFrame, load: Callable[[], Model], key: str, k: int, threshold: float | None = None, question: str = "question", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` by the model among those above the threshold; scores are rounded before they are ranked."""
    found = scored(pairs.select("query_id", key, question, text), load, question, text).withColumn("score", F.round("score", 6))
    return above_then_top(found, float("-inf") if threshold is None else threshold, k, key)


def word_overlap() -> Model:
    """The default: which share of a question's distinct index tokens a text holds."""
    words, stop = re.compile(r"\w+"), set(L.LEXICAL_STOPWORDS)
    tokens = lambda t: {w for w in words.findall(t.lower()) if len(w) >= 3 and w not in stop}

    def score(questions: list[str], texts: list[str]) -> list[float]:
        asked = {q: tokens(q) for q in set(questions)}
        held = {t: tokens(t) for t in set(texts)}
        return [len(asked[q] & held[t]) / max(len(asked[q]), 1) for q, t in zip(questions, texts)]

    return score
