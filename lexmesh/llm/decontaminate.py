"""Benchmark passages inside documents, up to a share of edited words.

Words are symbols. From every word of a document, and from every word of an item, a
CGK walk reads the words that follow: at step j a hash of the current word says
whether to go on to the next one. Two texts that differ by few edits are so mapped
to sequences that differ at few steps. A key is a sample of steps of one walk;
several walks, each with its own hash and sample, give every item several keys from
each of its words, and a document's key that an item has is a candidate. A walk
reads only as far as an item reaches, so windows are of the items' own size. How many
walks, and how many levels of shorter ones besides, an item needs is found from its
length by simulated edits: the first repetitions that find the target share of copies
with all edits allowed. Each
candidate is verified by the exact edit distance between the item and the best
stretch of the document around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import held, slices

#: Steps of a walk and how many of them a key samples, from the longest; an item uses the first it is long enough for.
LEVELS = ((24, 6), (12, 4), (6, 3), (2, 2))
#: (walks, shorter levels besides) in the order in which they are tried.
REPETITIONS = ((4, 0), (4, 1), (4, 2), (4, 3), (8, 2), (8, 3), (16, 3), (32, 3))
TARGET = 0.99
#: Longer items are served as those of so many words, which are found more surely the longer they are.
_SIMULATED = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FILTER_BITS = 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STRIDE, _SPAN = 1 << 12, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(places: np.ndarray) -> np.ndarray:
    """The base to each power, from two short tables."""
    low = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_STRIDE - 1, _BASE, np.uint64)]), dtype=np.uint64)
    rows = int(places.max(initial=0)) // _STRIDE + 1
    high = np.cumprod(np.concatenate([[np.uint64(1)], np.repeat(low[-1:] * _BASE, rows - 1)]), dtype=np.uint64)
    found = low[places % _STRIDE]
    return found if rows == 1 else found * high[places // _STRIDE]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The base to each power up to a span, and its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(_SPAN, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word of all texts, number of words per text). Words are runs of letters and digits, lower-cased."""
    parts = [(t or "").lower().encode() for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = _WORD[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # stretches of up to a million bytes, a longer word whole
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, side="right")))
        some = raw[starts[at]:ends[stop - 1]]
        if len(some) <= _SPAN:
            up, down = held("powers", _tables)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((some + np.uint64(1)) * up[:len(some)], dtype=np.uint64)])
            begin = starts[at:stop] - starts[at]
            found[at:stop] = (sums[ends[at:stop] - starts[at]] - sums[begin]) * down[begin]
        else:
            found[at] = ((some + np.uint64(1)) * _powers(np.arange(len(some)))).sum()
        at = stop
    found = _mix(found)
    firsts = np.cumsum([0] + [len(p) + 1 for p in parts])
    return found, np.diff(np.searchsorted(starts, firsts))


def _plan(level: int, walk: int) -> tuple[int, np.ndarray]:
    """Steps of a level and the steps that its key samples on a walk."""
    steps, samples = LEVELS[level]
    return steps, np.sort(np.random.default_rng(1000 * walk + level).choice(steps, samples, replace=False))


def _keys(words: np.ndarray, walk: int, levels: list[int]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Per level, the key of the walk from each word, and the word at which the last sampled step stood."""
    turns = _mix(words * np.uint64(2 * walk + 3)).astype(np.uint32)
    at = np.arange(len(words), dtype=np.int32)
    last = np.int32(len(words) - 1)
    plans = {k: _plan(k, walk) for k in levels}
    keys = {k: np.zeros(len(words), np.uint64) for k in levels}
    ends = {}
    for j in range(max(steps for steps, _ in plans.values())):
        for k, (_, sample) in plans.items():
            if j in sample:
                keys[k] += np.take(words, at) * np.uint64(2 * (j * 7919 + 31 * k) + 1)
                if j == sample[-1]:
                    ends[k] = at.copy()
        at += (np.take(turns, at) >> np.uint32(j) & np.uint32(1)).astype(np.int32)
        np.minimum(at, last, out=at)
    return {k: _mix(v) for k, v in keys.items()}, ends


def recall(size: int, similarity: float, walks: int, shorter: int, trials: int = 600, seed: int = 0) -> float:
    """The share of simulated copies of items of ``size`` distinct words, with all edits allowed at random places, that share a key with their item."""
    rng = np.random.default_rng([seed, size])
    pad, allowed = LEVELS[0][0], int((1 - similarity) * size + 1e-9)
    fresh = lambda n: rng.integers(1, 1 << 63, n, np.uint64)
    items = np.zeros((trials, size + pad), np.uint64)
    items[:, :size] = fresh((trials, size))
    copies = []
    for item in items[:, :size]:
        words = item.tolist()
        for new, where, kind in zip(fresh(allowed).tolist(), rng.random(allowed), rng.integers(0, 3, allowed)):
            at = int(where * len(words))
            words[at:at + 1] = [[new], [], [*words[at:at + 1], new]][kind]
        copies.append(np.concatenate([fresh(pad), np.array(words, np.uint64), fresh(pad)]))
    trial, tags = np.repeat(np.arange(trials), [len(c) for c in copies]), _mix(fresh(trials))
    texts, levels, hit = np.concatenate(copies), list(range(len(LEVELS))), np.zeros(trials, bool)
    for walk in range(walks):
        keys, ends = _keys(items.ravel(), walk, levels)
        there, _ = _keys(texts, walk, levels)
        first = np.full(trials, -1)
        for level in levels:
            whole = (ends[level].reshape(trials, -1) - np.arange(trials)[:, None] * (size + pad))[:, :size] < size
            serves = (whole.sum(axis=1) * 3 >= size) & whole[:, 0] if level < levels[-1] else np.ones(trials, bool)
            first = np.where((first < 0) & serves, level, first)
            if size == 1 and level == levels[-1]:
                whole[:] = True
            row, at = np.nonzero(whole & ((first >= 0) & (level <= first + shorter))[:, None])
            hit[row[np.isin(keys[level].reshape(trials, -1)[row, at] ^ tags[row], there[level] ^ tags[trial])]] = True
    return float(hit.mean())


@lru_cache(maxsize=4096)
def repetitions(size: int, similarity: float, target: float) -> tuple[int, int]:
    """(walks, shorter levels besides) by which the target share of copies of items of ``size`` words is found."""
    for walks, shorter in REPETITIONS:
        if recall(size, similarity, walks, shorter) >= target:
            return walks, shorter
    raise ValueError(f"no repetitions find {target} of the copies of items of {size} words at similarity {similarity}")


@dataclass
class Items:
    """A block of items with the keys of their walks: sorted keys, and for each its item and offset."""

    ids: list
    words: list[np.ndarray]
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    filters: dict[tuple[int, int], tuple[np.uint64, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], similarity: float = 0.8, target: float = TARGET) -> Items:
        """From (id, text) rows; an item without words has no passage and is never found."""
        kept = [(i, symbols([t])[0]) for i, t in rows]
        kept = [(i, w) for i, w in kept if len(w)]
        found: dict[tuple[int, int], list] = {}
        for n, (_, words) in enumerate(kept):
            walks, shorter = repetitions(min(len(words), _SIMULATED), similarity, target)
            for walk in range(walks):
                first = None
                padded = np.concatenate([words, np.zeros(LEVELS[0][0], np.uint64)])
                keys, ends = _keys(padded, walk, list(range(len(LEVELS))))
                for level in range(len(LEVELS)):
                    whole = np.flatnonzero(ends[level][:len(words)] < len(words))
                    # A level serves an item if walks from a third of its words, and from its first word, end inside it.
                    if first is None and (len(whole) * 3 >= len(words) and (whole[:1] == 0).any() or level == len(LEVELS) - 1):
                        first = level
                    if first is not None and level <= first + shorter:
                        if not len(whole):  # a single word: the walk stays on it
                            whole = np.zeros(1, np.int64)
                        found.setdefault((walk, level), []).append((keys[level][whole], np.full(len(whole), n), whole))
        tables, filters = {}, {}
        for place, parts in found.items():
            key, item, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            tables[place] = key[order], item[order], offset[order]
            shift = np.uint64(64 - min(_FILTER_BITS, max(14, len(key).bit_length() + 8)))  # about one in 250 is set
            there = np.zeros(1 << int(64 - shift), bool)
            there[key >> shift] = True
            filters[place] = shift, there
        return cls([i for i, _ in kept], [w for _, w in kept], tables, filters)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, word at which the item would begin) rows; the beginning may lie before the first word."""
        out = [np.empty((0, 2), np.int64)]
        for walk in sorted({w for w, _ in self.tables}):
            levels = sorted(level for w, level in self.tables if w == walk)
            if not levels or not len(words):
                continue
            keys, _ = _keys(words, walk, levels)
            for level in levels:
                table, item, offset = self.tables[walk, level]
                shift, there = self.filters[walk, level]
                some = np.flatnonzero(there[keys[level] >> shift])
                first = np.searchsorted(table, keys[level][some], side="left")
                count = np.searchsorted(table, keys[level][some], side="right") - first
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                out.append(np.stack([item[at], np.repeat(some, count) - offset[at]], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def _distances(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance between the item and the best stretch of each window (rows, width), and the column where it ends."""
    steps = np.arange(windows.shape[1] + 1)
    row = np.zeros((len(windows), windows.shape[1] + 1), np.int64)
    for i, word in enumerate(item, 1):
        below = np.empty_like(row)
        below[:, 0] = i
        below[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != word))
        row = np.minimum.accumulate(below - steps, axis=1) + steps
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def matches(items: Items, texts: list[str | None], similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, item's words, word at which the stretch ends) of each text and item that meet, by the fewest edits."""
    words, counts = symbols(texts)
    upto = np.concatenate([[0], np.cumsum(counts)])
    found = items.candidates(words)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for n in np.unique(found[:, 0]):
        item, begins = items.words[n], found[found[:, 0] == n, 1]
        size = len(item)
        allowed = int((1 - similarity) * size + 1e-9)
        # A walk may end in one text and begin in another; the words it shares lie in the text of its middle.
        text = np.clip(np.searchsorted(upto, np.clip(begins + size // 2, 0, len(words) - 1), side="right") - 1, 0, len(texts) - 1)
        both = [(t, b) for t, b in zip(text, begins)]
        both += [(t + d, b) for t, b in both for d in (-1, 1) if 0 <= t + d < len(texts) and b < upto[t + d + 1] and b + size > upto[t + d]]
        both = np.array(both)
        width = size + 2 * allowed + 2
        for at in range(0, len(both), 4096):
            some = both[at:at + 4096]
            place = (some[:, 1] - allowed - 1)[:, None] + np.arange(width)
            inside = (place >= upto[some[:, 0]][:, None]) & (place < upto[some[:, 0] + 1][:, None])
            windows = np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
            edits, end = _distances(item, windows)
            for (t, b), e, stop in zip(some.tolist(), edits.tolist(), end.tolist()):
                if e <= allowed and e < best.get((t, int(n)), (allowed + 1,))[0]:
                    best[t, int(n)] = e, int(b - allowed - 1 + stop - upto[t])
    return [(t, n, e, len(items.words[n]), stop) for (t, n), (e, stop) in sorted(best.items())]


def blocks(benchmark: DataFrame, similarity: float = 0.8, target: float = TARGET, key: str = "item_id", text: str = "text", size: int = 5000,
           most: int = 4 << 20) -> Iterator[Items]:
    """The items in blocks of ``size`` rows or ``most`` characters, small enough to be sent to every task. Repeated rows count once."""
    rows = benchmark.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull()).distinct()
    held: list[tuple] = []
    chars = 0
    for row in rows.orderBy(key, text).toLocalIterator():
        held.append(tuple(row))
        chars += len(row[1])
        if len(held) == size or chars >= most:
            yield Items.of(held, similarity, target)
            held, chars = [], 0
    if held:
        yield Items.of(held, similarity, target)


def leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text",
          target: float = TARGET) -> DataFrame:
    """(key, item_id, edits, item_words, end_word): items of which a document holds a stretch within ``1 - similarity`` edits a word.

    ``end_word`` is the number of the document's words up to the stretch's end. One pass
    over the texts for each block of items; nothing is shuffled. Null and empty texts
    hold no item, null keys and repeated rows each give their rows, extra columns are
    ignored, an empty table on either side gives no rows.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, item_id long, edits int, item_words int, end_word long"
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items in blocks(benchmark, similarity, target):
        shared = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, "text", 1 << 20):
                found = matches(items, batch.column("text").to_pylist(), similarity)
                text, item, edits, size, end = (np.array(x, np.int64) for x in (zip(*found) if found else [[]] * 5))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(text)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(edits.astype(np.int32)),
                     pa.array(size.astype(np.int32)), pa.array(end)], ["key", "item_id", "edits", "item_words", "end_word"])

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out.withColumnRenamed("key", key)


def keep(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", target: float = TARGET) -> DataFrame:
    """The rows, with all their columns, that hold no item. Whole rows pass through, so nothing is joined by key."""
    spark, out = documents.sparkSession, documents
    for items in blocks(benchmark, similarity, target):
        shared = spark.sparkContext.broadcast(items)

        def passing(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text, 1 << 20):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(shared.value, batch.column(text).to_pylist(), similarity)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(passing, documents.schema)
    return out
