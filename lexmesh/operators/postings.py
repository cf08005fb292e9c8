"""Postings: which terms each document holds, how often and where. Built in one pass, kept as segments.

A text is cut into terms where it is read and its terms are counted there, so no text and no token
is ever shuffled. A store is a folder of segments, one for each batch of documents that
came; of a document that came again the newest segment counts, and removal is a segment that holds
its key only. So a change writes what changed; ``compact`` folds the segments into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions.text import lexical_tokens
from lexmesh.session import dealt, written

_SCHEMA = "doc_id long, dl int, term string, tf int, positions array<int>"
DOCUMENT = ""  # the term of the row that stands for a document itself; no token is empty
GONE = -1  # the length of a document that was removed
RUN_TOKENS = 200_000  # tokens that a worker counts at once
TASK_PAIRS = 2_000_000  # pairs of a question and a document that one task scores


def runs(batches: Iterator[pa.RecordBatch], column: str, most: int = RUN_TOKENS) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose lists hold ``most`` entries together, or one row, so that a worker's memory is bounded by these and not by a batch."""
    for batch in batches:
        begin, at = batch.column(column).offsets.to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(begin, int(begin[at]) + most, "right")) - 1)
            yield batch.slice(at, min(end, batch.num_rows) - at)
            at = end
    pa.default_memory_pool().release_unused()  # the worker is used again by tasks of other stages


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf, positions) from (doc_id, text), and a row with an empty term for each document.

    Terms are the index tokens of ``lexical_tokens``; positions ascend from 0. Null texts have no tokens.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "tokens"):
            tokens, rows = batch.column("tokens"), batch.num_rows
            begin = tokens.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(begin)
            coded = tokens.flatten().dictionary_encode()
            document = np.repeat(np.arange(rows), sizes)
            place = np.arange(len(document)) - np.repeat(begin[:-1] - begin[0], sizes)
            key = document * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            cuts = np.append(first, len(order)).astype(np.int32)
            doc = document[order][first]
            own = np.arange(rows)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column("doc_id").take(pa.array(doc)), batch.column("doc_id")]),
                pa.array(np.concatenate([sizes[doc], sizes[own]]).astype(np.int32)),
                pa.concat_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[first]))), pa.array([DOCUMENT] * rows, pa.string())]),
                pa.array(np.concatenate([np.diff(cuts), np.zeros(rows, np.int32)]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([cuts, np.full(rows, cuts[-1], np.int32)])), pa.array(place[order].astype(np.int32)))],
                ["doc_id", "dl", "term", "tf", "positions"])

    tokens = F.coalesce(lexical_tokens(F.col("text")), F.array().cast("array<string>"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("tokens")).mapInArrow(count, _SCHEMA)


def _spelled(words: pa.Array, codes: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    return pa.compute.binary_join_element_wise(*(words.take(pa.array(codes[at + i])) for i in range(size)), " ")


def _is_in(terms: pa.Array, known: list[str]) -> np.ndarray:
    return pa.compute.is_in(terms, value_set=pa.array(known, terms.type)).to_numpy(zero_copy_only=False)


def _coded_grams(batch: pa.RecordBatch, words: str, size: int, parts: list[str] | None) -> tuple:
    """(words, code of the word at each place, row of each place, places where a gram begins, code of each gram) of a batch.

    With ``parts`` only grams stay whose parts, all words but the last and all but the first, are both among them.
    """
    tokens = batch.column(words)
    document = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))
    coded = tokens.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(coded.dictionary)

    def cut(at: np.ndarray, n: int) -> np.ndarray:
        gram = codes[at]
        for i in range(1, n):
            gram = np.unique(gram * width + codes[at + i], return_inverse=True)[1]
        return gram

    whole = lambda n: (at := np.arange(max(0, len(codes) - n + 1)))[document[at] == document[at + n - 1]]
    at = whole(size)
    if parts is not None and len(at):
        within = whole(size - 1)
        _, first, each = np.unique(cut(within, size - 1), return_index=True, return_inverse=True)
        sound = np.zeros(len(codes), bool)
        sound[within] = _is_in(_spelled(coded.dictionary, codes, within[first], size - 1), parts)[each]
        at = at[sound[at] & sound[at + 1]]
    return coded.dictionary, codes, document, at, cut(at, size) if len(at) else at


def grams(listed: DataFrame, keep: list[str], words: str, size: int, only: list[str] | None = None) -> DataFrame:
    """(keep..., term, tf): runs of ``size`` words of a row's list, joined by spaces, with their number in that row. No word holds a space.

    ``only`` names the terms that are wanted, as many as a task may be sent.
    """
    wanted = None if only is None else listed.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, words):
            held, codes, document, at, gram = _coded_grams(batch, words, size, None)
            if not len(at):
                continue
            if wanted is not None:
                _, first, each = np.unique(gram, return_index=True, return_inverse=True)
                known = _is_in(_spelled(held, codes, at[first], size), wanted.value)[each]
                at, gram = at[known], gram[known]
                if not len(at):
                    continue
            _, first, tf = np.unique(document[at] * (gram.max() + 1) + gram, return_index=True, return_counts=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(document[at])) for k in keep), _spelled(held, codes, at, size), pa.array(tf.astype(np.int64))], [*keep, "term", "tf"])

    rows = listed.select(*keep, words)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{kinds}, term string, tf long")


def gram_totals(listed: DataFrame, words: str, size: int, parts: list[str] | None = None) -> DataFrame:
    """(term, df, tf): as ``grams``, added up over the rows that a task has at once; ``df`` is the number of rows that hold the term.

    ``parts``, as many as a task may be sent: grams whose parts are not among them are left out where the words are read.
    """
    sent = None if parts is None else listed.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, words):
            held, codes, document, at, gram = _coded_grams(batch, words, size, None if sent is None else sent.value)
            if not len(at):
                continue
            _, first, tf = np.unique(gram, return_index=True, return_counts=True)
            df = np.unique(np.unique(document[at] * (gram.max() + 1) + gram) % (gram.max() + 1), return_counts=True)[1]
            yield pa.RecordBatch.from_arrays([_spelled(held, codes, at[first], size), pa.array(df.astype(np.int64)), pa.array(tf.astype(np.int64))], ["term", "df", "tf"])

    return listed.select(words).mapInArrow(count, "term string, df long, tf long")


@dataclass
class Index:
    """Postings of live documents; every lexical plan reads this and no text."""

    rows: DataFrame

    @classmethod
    def of(cls, documents: DataFrame | Index) -> Index:
        return documents if isinstance(documents, Index) else cls(written(postings(documents)))

    @property
    def terms(self) -> DataFrame:
        return self.rows.where(F.col("term") != DOCUMENT)

    def holding(self, terms: DataFrame, *columns: str) -> DataFrame:
        """Rows whose term is among ``terms`` (query_id, term), spread by document, so that scores of one document add up in one task.

        Every document may hold a term of every question: tasks are as many as bound these pairs in each.
        """
        pairs = self.totals()[0] * terms.select("query_id").distinct().count()
        found = self.terms.select("doc_id", "dl", "term", *columns).join(terms.select("term").distinct(), "term", "left_semi")
        return dealt(found, "doc_id", pairs, TASK_PAIRS)

    def totals(self) -> tuple[int, int]:
        """(documents, tokens)."""
        row = self.rows.where(F.col("term") == DOCUMENT).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        return row.n, row.t

    def frequencies(self) -> DataFrame:
        """(term, n): the number of documents that hold it."""
        return self.terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


class Store:
    """Segments under a folder, numbered as they came."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def segments(self) -> list[int]:
        """Numbers of the segments that are whole, ascending; those that a compaction replaced are left out."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/segment=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        names = [f.getPath().getParent().getName().split("=")[1] for f in found or []]
        base = max((int(n.split("-")[0]) for n in names if n.endswith("-base")), default=-1)
        return [base] * (base >= 0) + sorted(int(n) for n in names if not n.endswith("-base") and int(n) > base)

    def _path(self, number: int) -> str:
        base = f"{self.folder}/segment={number}-base"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/_SUCCESS")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return base if there else f"{self.folder}/segment={number}"

    def _next(self) -> int:
        return max(self.segments(), default=-1) + 1

    def add(self, documents: DataFrame) -> None:
        """Documents that are new or have changed, one row a key."""
        postings(documents).write.mode("overwrite").parquet(f"{self.folder}/segment={self._next()}")

    def remove(self, keys: DataFrame) -> None:
        """Documents (doc_id) that are gone."""
        gone = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(GONE).alias("dl"), F.lit(DOCUMENT).alias("term"), F.lit(0).alias("tf"), F.array().cast("array<int>").alias("positions"))
        gone.write.mode("overwrite").parquet(f"{self.folder}/segment={self._next()}")

    def index(self) -> Index:
        """The index of live documents. With one segment it is read as it is; with more, rows of a document's newest segment alone."""
        numbers = self.segments()
        parts = [self.spark.read.schema(_SCHEMA).parquet(self._path(n)).withColumn("segment", F.lit(n)) for n in numbers]
        if not parts:
            return Index(self.spark.createDataFrame([], _SCHEMA))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        if len(parts) > 1:
            newest = whole.where(F.col("term") == DOCUMENT).groupBy("doc_id").agg(F.max("segment").alias("segment"))
            whole = whole.join(newest, ["doc_id", "segment"], "left_semi")
        return Index(whole.where(F.col("dl") != GONE).drop("segment"))

    def compact(self) -> None:
        """One segment for all that live; readers that began before go on with the old ones."""
        numbers = self.segments()
        if len(numbers) > 1:
            self.index().rows.write.mode("overwrite").parquet(f"{self.folder}/segment={numbers[-1]}-base")
