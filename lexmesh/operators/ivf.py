"""Vector search through inverted lists: vectors lie in the list of their nearest centroid, a question reads the lists nearest to it.

Centroids are fitted on a bounded sample; every vector is indexed. Lists are folders of the stored
index, so a search reads the probed ones alone. A long list is dealt into chunks and a
question goes to each chunk of its lists, so no task holds a list of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.operators.dense import _unit, dense_topk
from lexmesh.operators.fusion import top_k
from lexmesh.session import shared_folder, written

CHUNK = 20_000  # vectors of a list that one task compares at once
LEARNT = 64  # sampled vectors for each list


class InvertedLists:
    """An index under a folder: ``list=N`` folders of (id, vec) with unit vectors, and the centroids."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, chunks: dict[int, int]) -> None:
        self.rows, self.centroids, self.chunks = rows, centroids, chunks

    @classmethod
    def build(cls, corpus: DataFrame, folder: str, lists: int | None = None, seed: int = 1) -> InvertedLists:
        """From corpus (id, vec). ``lists`` defaults to the root of the number of vectors, 4,096 at most; zero vectors are kept in the first list."""
        spark, count = corpus.sparkSession, max(corpus.count(), 1)
        lists = max(1, min(lists or int(count ** 0.5), 4096, count))
        share = min(1.0, 1.2 * LEARNT * lists / count)
        sample = corpus.where(F.xxhash64("id") <= int(-(1 << 63) + share * ((1 << 64) - 2048))) if share < 1 else corpus
        some = sample.where(F.exists("vec", lambda x: x != 0)).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        if some.isEmpty():  # a single list then
            centroids = np.zeros((1, 1))
        else:
            centroids = np.array(KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine" if lists > 1 else "euclidean").fit(some).clusterCenters())

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    unit = _unit(batch["vec"])
                    near = (unit @ _unit(pd.Series(list(centroids))).T).argmax(axis=1) if unit.shape[1] == centroids.shape[1] else np.zeros(len(unit), int)
                    yield pd.DataFrame({"id": batch["id"], "vec": list(unit), "list": near.astype(np.int32)})

        placed = corpus.select("id", "vec").mapInPandas(assign, "id long, vec array<double>, list int")
        placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(folder)
        rows = spark.read.schema("id long, vec array<double>, list int").parquet(folder)
        sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each list
        return cls(rows, centroids, {r["list"]: -(-r.n // CHUNK) for r in sizes})

    def search(self, questions: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, score, rank) from questions (query_id, vec): the best ``k`` of the ``probes`` lists nearest to each, by cosine. All lists: exact."""
        centroids, chunks = _unit(pd.Series(list(self.centroids))), self.chunks

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    unit = _unit(batch["vec"])
                    fits = unit.shape[1] == centroids.shape[1]  # else nothing was learnt and there is one list
                    near = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes] if fits else np.zeros((len(unit), 1), int)
                    found = [(q, u, int(n), c) for q, u, row in zip(batch["query_id"], unit, near) for n in row for c in range(chunks.get(int(n), 0))]
                    yield pd.DataFrame(found, columns=["query_id", "vec", "list", "chunk"])

        asked = questions.select("query_id", "vec").mapInPandas(probe, "query_id long, vec array<double>, list int, chunk int")
        wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # no more than there are lists
        dealt = F.create_map(*(x for n, c in chunks.items() for x in (F.lit(n), F.lit(c))))[F.col("list")] if chunks else F.lit(1)
        there = self.rows.where(F.col("list").isin(wanted)).withColumn("chunk", F.pmod(F.xxhash64("id"), dealt).cast("int"))

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            scores = np.round(np.stack(right["vec"]) @ np.stack(left["vec"]).T, 6) + 0.0
            ids, out = left["id"].to_numpy(), []
            for q, row in zip(right["query_id"], scores):
                best = np.lexsort((ids, -row))[:k]
                out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": row[best]}))
            return pd.concat(out)

        found = there.groupBy("list", "chunk").cogroup(asked.groupBy("list", "chunk")).applyInPandas(compare, "query_id long, id long, score double")
        return top_k(found, k, "id")


def with_recall(index: InvertedLists, corpus: DataFrame, questions: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, id, score, rank, hallado): the exact best ``k`` of each question, and whether the lists give them."""
    exact = dense_topk(corpus, questions, k)
    near = index.search(questions, k, probes).select("query_id", "id", F.lit(True).alias("hallado"))
    return exact.join(near, ["query_id", "id"], "left").withColumn("hallado", F.coalesce("hallado", F.lit(False)))


def probes_for(index: InvertedLists, corpus: DataFrame, questions: DataFrame, k: int, target: float = 0.9, sample: int = 256) -> int:
    """How many lists to read for a share ``target`` of the exact best ``k``, measured on at most about ``sample`` questions; from four up, doubled until it is reached."""
    share = 1.2 * sample / max(questions.count(), 1)
    some = questions if share >= 1 else questions.where(F.xxhash64("query_id") <= int(-(1 << 63) + share * ((1 << 64) - 2048)))
    some = written(some.select("query_id", "vec"))
    exact = written(dense_topk(corpus, some, k).select("query_id", "id"))
    wanted, probes = exact.count(), 4
    while probes < len(index.centroids):
        if index.search(some, k, probes).join(exact, ["query_id", "id"], "left_semi").count() >= target * wanted:
            return probes
        probes *= 2
    return len(index.centroids)


def folder_of(spark, name: str) -> str:
    return f"{shared_folder(spark)}/lists/{name}"
