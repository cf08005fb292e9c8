"""Language identification with the byte network of ``gru``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm import gru
from lexmesh.llm.common import held, slices

UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    network: gru.Network


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 2000, per_text: int = 24,
        hidden: int = 8, rounds: int = 400) -> Model:
    """Train on at most ``sample`` labelled texts of each language, those whose hash of the key is least, and ``per_text`` runs of each spread over the text.

    Rows without text or language teach nothing. Without any labelled row the model
    knows no language and finds every text undetermined.
    """
    rows = documents.select(F.xxhash64(key).alias("h"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    runs_of = (F.octet_length("text") / gru.RUN).cast("long")
    # The runs are cut where the text is: the driver gets `sample * per_text` runs of each language at most.
    spots = F.transform(F.sequence(F.lit(0), F.least(F.lit(per_text - 1), runs_of)), lambda i: (i * (runs_of + 1) / per_text).cast("long") * gru.RUN)
    spots = F.when(runs_of < per_text, F.transform(F.sequence(F.lit(0), F.least(F.lit(per_text - 1), runs_of)), lambda i: i.cast("long") * gru.RUN)).otherwise(spots)
    # A row per language tells which hashes are low enough; only texts that are about to be taken move.
    counts = documents.select(F.col(lang).cast("string").alias("lang")).where("lang is not null").groupBy("lang").count().collect()
    bounds = [x for r in counts for x in (F.lit(r["lang"]), F.lit(int(-(1 << 63) + min(1.0, 1.2 * sample / r["count"]) * ((1 << 64) - 2048))))]
    low = F.col("h") <= F.create_map(*bounds)[F.col("lang")] if bounds else F.lit(False)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = rows.where(low).withColumn("n", first).where(F.col("n") <= sample)
    cut = picked.select("lang", "h", F.transform(spots, lambda i: F.substring(F.col("text").cast("binary"), i.cast("int") + 1, F.lit(gru.RUN))).alias("runs"))
    got = cut.orderBy("h").toArrow().to_pylist()
    languages = sorted({r["lang"] for r in got})
    pieces = [(bytes(p), languages.index(r["lang"])) for r in got for p in r["runs"] if p]
    if not pieces:
        return Model([], gru.Network.fresh(hidden, 1))
    codes, lengths, _ = gru.runs([p for p, _ in pieces])
    classes = np.array([c for _, c in pieces])
    return Model(languages, gru.train(codes, lengths, classes, len(languages), hidden, rounds))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, probability) of each text; undetermined with 0 where there is no letter."""
    asked = [bool(t and model.languages and any(map(str.isalpha, t))) for t in texts]
    chances = gru.pooled(model.network, [t.encode() for t, a in zip(texts, asked) if a])
    best = chances.argmax(axis=1) if len(chances) else []
    names, scores, at = [], np.zeros(len(texts)), 0
    for i, a in enumerate(asked):
        if not a:
            names.append(UNDETERMINED)
            continue
        names.append(model.languages[best[at]])
        scores[i] = min(1.0, float(chances[at, best[at]]))
        at += 1
    return names, scores


def identify(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row, without a shuffle.

    Null text and text without a letter give ``und`` with score 0; null keys and
    repeated rows pass through, extra columns are ignored, an empty table gives an empty one.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language", dict)  # what other operators kept here goes
        for batch in slices(batches, "text", 1 << 20):
            names, scores = predict(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.string()), pa.array(scores)], ["key", "lang_pred", "score"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(find, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep(documents: DataFrame, model: Model, wanted: Column | None = None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is recognised with at least that probability.

    Whole rows pass through the network's task, so nothing is joined by key: repeated
    rows, null keys and extra columns stay as they are. Undetermined texts go.
    """
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language", dict)
        for batch in slices(batches, text, 1 << 20):
            _, scores = predict(model, batch.column(text).to_pylist())
            yield batch.filter(pa.array(scores >= least))

    return (documents if wanted is None else documents.where(wanted)).mapInArrow(passing, documents.schema)
