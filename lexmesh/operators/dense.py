"""Exact cosine search over vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.operators.fusion import top_k

BLOCK_BYTES = 16 << 20  # question vectors sent to every task at once, as doubles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; a zero vector gives 0."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


# The letters counted by the default embedder.
LETTERS = "abcdefghijklmnopqrstuvwxyzñáéíóú"


# What some models want in front of a question and of a passage.
QUESTION_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def letter_vector(text: Column, prefix: str = "") -> Column:
    """Deterministic default embedder: how often each letter occurs, a prefix's too. A model may replace it."""
    low = F.lower(F.concat(F.lit(prefix), text) if prefix else text)
    total = F.length(low)
    return F.array(*[(total - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack(rows.to_numpy()).astype(np.float64)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best(ids, vectors: np.ndarray, query_ids, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Rows of one batch that can still be among the best ``k`` of a question; of equal scores the least ids, nulls first."""
    scores = np.round(vectors @ queries.T, 6) + 0.0
    if len(scores) > k:
        # Rows come in the order of their ids, so that of equal scores at the cut the first are taken.
        order = np.argsort(np.where(pd.isna(ids), -np.inf, ids) if pd.isna(ids).any() else np.asarray(ids), kind="stable")
        ids, scores = np.asarray(ids)[order], scores[order]
        floor = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        above, level = scores > floor, scores == floor
        row, col = np.nonzero(above | level & (np.cumsum(level, axis=0, dtype=np.int32) <= k - above.sum(axis=0)))
    else:
        row, col = np.indices(scores.shape).reshape(2, -1)
    return pd.DataFrame({
        "query_id": np.asarray(query_ids)[col], "id": np.asarray(ids)[row], "score": scores[row, col]})


def _question_blocks(questions: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of consecutive questions, each block within ``BLOCK_BYTES``; the driver holds one at a time."""
    ids, vectors = [], []
    for row in questions.select("query_id", "vec").toLocalIterator():
        ids.append(row["query_id"])
        vectors.append(np.asarray(row["vec"], np.float64))
        if vectors[0].nbytes * (len(vectors) + 1) > BLOCK_BYTES:
            yield np.array(ids), _unit(pd.Series(vectors))
            ids, vectors = [], []
    if ids:
        yield np.array(ids), _unit(pd.Series(vectors))


def dense_topk(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) from corpus (id, vec) and questions (query_id, vec), both bigint ids.

    Blocks of question vectors, bounded in bytes, go to every task; each Arrow batch of the corpus
    keeps its best ``k`` of every question. The corpus is never copied or moved: each
    block is one more pass over it, and one question's candidates meet once at the end.
    """
    schema = "query_id bigint, id bigint, score double"
    spark, found = corpus.sparkSession, None
    for query_ids, queries in _question_blocks(questions):
        shared = spark.sparkContext.broadcast((query_ids, queries))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            query_ids, queries = shared.value
            for batch in batches:
                if len(batch):
                    yield _best(batch["id"], _unit(batch["vec"]), query_ids, queries, k)

        part = corpus.select("id", "vec").mapInPandas(scan, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(spark.createDataFrame([], schema) if found is None else found, k, "id")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, dimension by dimension so that partial sums merge on the map side."""
    parts = vectors.select(group, F.posexplode("vec").alias("dim", "x"))
    means = parts.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vec"))
