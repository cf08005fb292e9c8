"""Ranked lexical search over classes of documents that no query can tell apart.

Queries are items; only their words can score. A document is reduced to its bag, how often each word of
the items' vocabulary occurs in it, and to a length factor ``m``. Documents of equal bag and equal
``m`` have equal scores for every item, so they form a class: found by a hash, verified by comparing the
bags, and scored once. A class keeps its ``k`` least keys only, since more of them can't be
among the ``k`` best. The best classes of an item are expanded into documents by ascending key.

Items are served in blocks of bounded size; what is sent to tasks is one block's vocabulary and its
occurrences in items. Every block is one pass over the documents, in which nothing is shuffled but
bags of few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import slices
from lexmesh.session import written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CELLS = 2 << 20  # scores, or occurrences of words in items, that a task holds at once


def terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """(all terms of all texts, number of terms per text): runs of letters, digits and signs beyond ASCII, A-Z lower-cased."""
    parts = [(t or "").encode() for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    inside = _INSIDE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([0] + [len(p) + 1 for p in parts])
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spelt = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[inside])])
    return spelt, np.diff(np.searchsorted(starts, firsts))


@dataclass
class Items:
    """A block of items: the vocabulary, and by word the items that hold it and how often (``first[w]`` .. ``first[w + 1]``)."""

    ids: list
    words: pa.Array
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        found, counts = terms([t for _, t in rows])
        coded = found.dictionary_encode()
        words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, times = np.unique(word * max(len(rows), 1) + np.repeat(np.arange(len(rows)), counts), return_counts=True)
        word, item = np.divmod(pairs, max(len(rows), 1))
        return cls([i for i, _ in rows], words, np.searchsorted(word, np.arange(len(words) + 1)), item, times.astype(np.int64))


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", most: int = 8 << 20) -> Iterator[Items]:
    """Items in blocks of about ``most`` characters. Null texts have no words; of rows that share a key the least text counts."""
    rows = benchmark.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    held: list[tuple] = []
    chars = 0
    for row in rows.groupBy("key").agg(F.min("text").alias("text")).orderBy("key").toLocalIterator():
        if row.text is not None:
            held.append((row.key, row.text))
            chars += len(row.text) + 64
        if chars >= most:
            yield Items.of(held)
            held, chars = [], 0
    if held:
        yield Items.of(held)


def bags(documents: DataFrame, items: Items, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, words, times): terms of each whole text, and the numbers of those in the vocabulary, ascending, with their counts."""
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(items.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "text", 2 << 20):
            found, sizes = terms(batch.column("text").to_pylist())
            number = pa.compute.index_in(found, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            hits = number >= 0
            cells, times = np.unique(text_of[hits] * max(len(known), 1) + number[hits], return_counts=True)
            row, word = np.divmod(cells, max(len(known), 1))
            cuts = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(word.astype(np.int32))),
                 pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))], ["key", "n", "words", "times"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(count, f"key {kind}, n long, words array<int>, times array<int>"))


def classes(held: DataFrame, k: int) -> DataFrame:
    """(m, words, times, keys): one row for each distinct bag and ``m``, with the ``k`` least keys, ascending.

    The hash leads the comparison; bags of one class are compared whole. Each task first cuts its own rows
    of a class to ``k``, so copies by the million meet as a few rows.
    """
    same = ("_hash", "m", "words", "times")
    rows = held.where(F.size("words") > 0).withColumn("_hash", F.xxhash64("m", "words", "times"))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("key"))
    least = rows.select(*same, "key", rank.alias("rank")).where(F.col("rank") <= k)
    keys = F.transform(F.sort_array(F.collect_list(F.struct("key"))), lambda s: s["key"])
    return written(least.groupBy(*same).agg(keys.alias("keys")).drop("_hash"))


def _best(item: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each item: by score, then by least key."""
    order = np.lexsort((least, -score, item))
    first = np.searchsorted(item[order], item[order], side="left")
    return order[np.arange(len(order)) - first < k]


def scored(found: DataFrame, items: Items, weight: np.ndarray, k: int) -> DataFrame:
    """(item, score, keys): the ``k`` best classes of each item in each task, ``item`` its number in the block.

    A class meets the items that share a word with it through the word's list of items. Sums are exact 64-bit integers.
    """
    kind = found.schema["keys"].dataType.simpleString()
    useful = np.flatnonzero(weight)  # a word that nearly all documents hold adds nothing
    shared = found.sparkSession.sparkContext.broadcast((items.first, items.item, items.times, weight, len(items.ids)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, item, times, weights, n_items = shared.value
        spread = np.where(weights > 0, np.diff(first), 0)
        best: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        held, types = np.empty(0, object), None
        for batch in batches:
            types = batch.column("keys").type
            rows = batch.num_rows
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            word, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("words", "times"))
            row = np.repeat(np.arange(rows), sizes)
            value = weights[word] * (1_000_000_000 * tf // (1000 * tf + 12 * batch.column("m").to_numpy()[row]))
            keys = np.empty(rows, object)
            keys[:] = batch.column("keys").to_pylist()
            least = np.array([-(1 << 63) if x[0] is None else x[0] for x in keys], np.int64)
            work = np.concatenate([[0], np.cumsum(np.bincount(row, spread[word], rows).astype(np.int64) + n_items)])
            at, upto = 0, np.concatenate([[0], np.cumsum(sizes)])
            while at < rows:  # as many classes as stay within bounds, one at least
                stop = max(at + 1, int(np.searchsorted(work, work[at] + _CELLS, side="right")) - 1)
                some = slice(upto[at], upto[stop])
                count = spread[word[some]]
                entry = np.repeat(np.arange(len(count)), count)
                place = first[word[some]][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
                table = np.zeros((stop - at) * n_items, np.int64)
                np.add.at(table, (row[some][entry] - at) * n_items + item[place], value[some][entry] * times[place])
                hit = np.flatnonzero(table)
                mine = (hit % n_items, table[hit], least[at + hit // n_items])
                both = [np.concatenate([a, b]) for a, b in zip(best, mine)]
                names = np.concatenate([held, keys[at + hit // n_items]])
                top = _best(*both, k)
                best, held = tuple(b[top] for b in both), names[top]
                at = stop
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(held.tolist(), types)], ["item", "score", "keys"])

    if not len(useful):
        found = found.limit(0)
    return found.mapInArrow(score, f"item long, score long, keys {kind}")


def ranked(documents: DataFrame, benchmark: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", block: int = 8 << 20) -> DataFrame:
    """(item_id, rank, key, score): the ``k`` best documents above 0 for each item, equal scores by ascending key, null first.

    Null texts, and texts without a term, are in no list and count in no figure; rows that share a
    key each have their place, ties between them fall anyhow; extra columns are ignored; an empty table
    on either side gives no rows.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id long, rank int, {key} {kind}, score long")
    for items in blocks(benchmark, item_key, item_text, block):
        held = bags(documents, items, key, text)
        total = held.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        if not total.l or not len(items.words):
            continue
        n, length = int(total.n), int(total.l)
        df = np.zeros(len(items.words), np.int64)
        for row in held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
            df[row.word] = row.df  # one row for each word of the block
        weight = np.where(df > 0, np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))), 0).astype(np.int64)
        factor = F.expr(f"75L + (25L * n * {n}L) div {length}L")
        best = scored(classes(held.withColumn("m", factor), k), items, weight, k)
        named = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
        rows = best.select("item", "score", F.explode("keys").alias("key")).select("item", "key", "score", place.alias("rank")).where(F.col("rank") <= k)
        rows = rows.join(named, "item")
        out = out.unionByName(rows.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"))
    return out
