"""Class-based bigrams: words are exchanged between classes until the corpus is likeliest.

P(word | word before) = P(class | class before) * P(word | class). The most frequent
words form the classes by exchange clustering of their bigram counts; every further frequent word
then goes, by the same gain, to the class that makes the corpus likeliest, for which its neighbours' classes
are counted on Spark. Rare words
belong to a class by their shape (a sign at the end, the length in bytes), where each
has its own count from the whole corpus, and a word never seen counts as one more
word. The end of a document is a class of its own, and also stands before its start.

Counts cover all training texts. What tasks and driver hold is bounded by parameters:
``CLASSED`` words form classes, up to ``SHIPPED`` frequent words have one and are sent to
every task with their counts, none longer than ``LONGEST`` bytes. Any other word is
looked up by a join with the whole vocabulary. Such words are rare, or so long that
they are few; adaptive execution splits a key that is hot all the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import slices
from lexmesh.session import written

CLASSED, CLASSES, SHIPPED, LONGEST = 2048, 64, 65_536, 256
END = b""
_LENGTHS = (4, 7, 11)
SHAPES = 2 * (len(_LENGTHS) + 1)
_SIGNS = frozenset(b".,;:!?")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _SIGN = np.zeros(256, bool), np.zeros(256, np.int64)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN[list(_SIGNS)] = 1
_HELD = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # on bytes: A-Z only, and the six ASCII spaces


def shape(word: bytes) -> int:
    return 2 * sum(len(word) > n for n in _LENGTHS) + (word[-1] in _SIGNS)


def vocabulary(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, shape, n) over all texts; the end of a text is the empty word. Counted in tasks before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([shape(w) if w else SHAPES for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                ["word", "shape", "n"])
            seen.clear()
            return out

        for batch in slices(batches, "text"):
            found = cut(batch.column("text").to_pylist())[0].value_counts()
            for word, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                seen[word] += n
            seen[END] += batch.num_rows
            if len(seen) > _HELD:
                yield flush()
        if seen:
            yield flush()

    rows = documents.select(F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> list[tuple[bytes, int, int]]:
    """(word, shape, n) of the most frequent words, at most ``most`` of up to ``LONGEST`` bytes, most frequent first; the end is left out.

    A histogram of counts by logarithm, bounded whatever the corpus, tells from which
    count on the words are few enough; of the next step those of least hash fill what is left.
    """
    own = words.where(F.octet_length("word").between(1, LONGEST))
    steps = own.groupBy(F.floor(F.log("n") * 256).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    wanted, total = F.lit(False), 0
    for row in sorted(steps, key=lambda r: -r.step):
        if total + row.words > most:
            share = (most - total) / row.words
            wanted = wanted | ((F.col("n") >= row.least) & (F.xxhash64("word") <= int(-(1 << 63) + share * ((1 << 64) - 2048))))
            break
        wanted, total = F.col("n") >= row.least, total + row.words
    found = own.where(wanted).toArrow().to_pylist()
    return sorted(((r["word"], r["shape"], r["n"]) for r in found), key=lambda r: (-r[2], r[0]))[:most]


def bigrams(documents: DataFrame, classed: list[bytes], text: str = "text") -> np.ndarray:
    """Counts (symbols, symbols) of neighbours; symbols are the classed words, then the shapes, then the end."""
    size = len(classed) + SHAPES + 1
    found = _pairs(documents, text, classed, size, lambda s: s[:-1] * size + s[1:]).toArrow()
    out = np.zeros(size * size)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def cut(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts, number of words per text, shape of each word): as ``words_of`` and ``shape`` have them, all at once."""
    parts = [t or b"" for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    spelt = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[inside])])
    counts = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts])))
    return spelt, counts, 2 * (sizes[:, None] > np.array(_LENGTHS)).sum(axis=1) + _SIGN[raw[ends - 1]]


def numbered(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, -1 if it is none."""
    return pa.compute.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def with_ends(symbols: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The symbols of all texts with the end before, between and behind them."""
    out = np.full(len(symbols) + len(counts) + 1, end, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(counts)), counts) + 1] = symbols
    return out


def _pairs(documents: DataFrame, text: str, words: list[bytes], symbols: int, codes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(code, n): how often each code arises from the symbols of the texts; words are symbols 0 on, then shapes, then the end."""
    shared = documents.sparkSession.sparkContext.broadcast(pa.array(words, pa.large_binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = shared.value, []
        for batch in slices(batches, "text"):
            found, counts, kinds = cut(batch.column("text").to_pylist())
            number = numbered(found, known)
            kept.append(codes(with_ends(np.where(number < 0, len(known) + kinds, number), counts, symbols - 1)))
            if sum(map(len, kept)) > 4_000_000:
                yield flush(kept)
                kept = []
        if kept:
            yield flush(kept)

    def flush(kept: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(kept), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    rows = documents.select(F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def assigned(documents: DataFrame, words: list[bytes], classes: np.ndarray, known: int, n_classes: int, grid: np.ndarray, text: str = "text") -> np.ndarray:
    """The class of each symbol: words from ``known`` on go to the class of most gain, or stay in that of their shape.

    ``classes`` has one for each word, shape and the end; ``grid`` counts class bigrams. The neighbours'
    classes of each such word are counted on Spark and its gain is worked out there.
    """
    total, symbols = len(grid), len(classes)
    width = 2 * total + 1  # per word: class behind it, class before it, itself behind it

    def codes(s: np.ndarray) -> np.ndarray:
        right = (s[:-1] >= known) & (s[:-1] < len(words))
        left = (s[1:] >= known) & (s[1:] < len(words))
        same = right & (s[:-1] == s[1:])
        return np.concatenate([s[:-1][right] * width + classes[s[1:]][right], s[1:][left] * width + total + classes[s[:-1]][left], s[:-1][same] * width + 2 * total])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for word, slots in zip(batch.column("word").to_pylist(), batch.column("slots").to_pylist()):
                row = np.zeros(width)
                for slot in slots:
                    row[slot["slot"]] = slot["n"]
                here, loop = int(classes[word]), row[-1]
                right, left = row[:total].copy(), row[total:2 * total].copy()
                right[here] -= loop
                left[here] -= loop
                rest = grid.copy()
                rest[here] -= right
                rest[:, here] -= left
                rest[here, here] -= loop
                among = np.append(np.arange(n_classes), here)
                gain = _gains(rest, among, right, left, loop)
                k = int(gain.argmax())
                best.append(int(among[k]) if gain[k] > gain[-1] + 1e-9 else here)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(best, pa.int64())], ["word", "class"])

    found = _pairs(documents, text, words, symbols, codes)
    slots = found.select(F.floor(F.col("code") / width).cast("long").alias("word"), F.struct(F.pmod("code", F.lit(width)).cast("int").alias("slot"), "n").alias("slot"))
    # A word has ``width`` slots at most.
    chosen = slots.groupBy("word").agg(F.collect_list("slot").alias("slots")).mapInArrow(choose, "word long, class long").toArrow()
    out = classes.copy()
    out[chosen.column("word").to_numpy()] = chosen.column("class").to_numpy()
    return out


def class_bigrams(documents: DataFrame, words: list[bytes], classes: np.ndarray, total: int, text: str = "text") -> np.ndarray:
    """Counts (class, class) of neighbours."""
    found = _pairs(documents, text, words, len(classes), lambda s: classes[s[:-1]] * total + classes[s[1:]]).toArrow()
    out = np.zeros(total * total)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(total, total)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(grid: np.ndarray, among: np.ndarray | slice, right: np.ndarray, left: np.ndarray, loop: float) -> np.ndarray:
    """What each class among those gains in likelihood by a word that is in no class now: classes behind it, before it, itself behind itself."""
    rows, columns = grid[among], grid[:, among].T
    gain = (_f(rows + right) - _f(rows)).sum(axis=1) + (_f(columns + left) - _f(columns)).sum(axis=1)
    diagonal, r, l = np.diagonal(grid)[among], right[among], left[among]  # noqa: E741
    gain += _f(diagonal + r + l + loop) + _f(diagonal) - _f(diagonal + r) - _f(diagonal + l)
    out, into = rows.sum(axis=1), columns.sum(axis=1)
    return gain - (_f(out + right.sum() + loop) - _f(out) + _f(into + left.sum() + loop) - _f(into))


def exchange(counts: np.ndarray, n_words: int, n_classes: int, rounds: int = 6) -> np.ndarray:
    """The class of each symbol: words move to the class that makes the corpus likeliest; other symbols keep a class each."""
    size = len(counts)
    n_classes = max(1, min(n_classes, n_words))
    own = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(size - n_words)])
    total = n_classes + size - n_words
    member = np.zeros((size, total))
    member[np.arange(size), own] = 1
    after, before = counts @ member, counts.T @ member  # (symbol, class that follows), (symbol, class before)
    grid = member.T @ after
    for _ in range(rounds):
        moved = 0
        for w in range(n_words):
            here, loop = own[w], counts[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[here] -= loop
            left[here] -= loop
            grid[here] -= right
            grid[:, here] -= left
            grid[here, here] -= loop
            gain = _gains(grid, slice(n_classes), right, left, loop)
            best = int(gain.argmax())
            best = best if gain[best] > gain[here] + 1e-9 else here
            grid[best] += right
            grid[:, best] += left
            grid[best, best] += loop
            if best != here:
                moved += 1
                own[w] = best
                after[:, here] -= counts[:, w]
                after[:, best] += counts[:, w]
                before[:, here] -= counts[w]
                before[:, best] += counts[w]
        if moved * 200 < n_words:
            break
    return own


@dataclass
class Model:
    """``known``: what a task needs of each shipped word: (its class, log10 of its chance in the class, log10 of its count + 1). ``steps``: log10 of class chances; ``tail``: log10 of the size of each shape's class."""

    tokens: int
    words: int
    known: dict[bytes, tuple[int, float, float]]
    steps: np.ndarray
    tail: np.ndarray
    first_shape: int
    end_count: int


def fit(documents: DataFrame, words: DataFrame, text: str = "text") -> Model:
    """The model for a vocabulary of the same documents."""
    sums = words.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()  # a row per shape
    tokens, distinct = sum(r.n for r in sums), sum(r.words for r in sums)
    shipped = frequent(words, SHIPPED)
    classed = shipped[:CLASSED]
    counts = bigrams(documents, [w for w, _, _ in classed], text)
    own = exchange(counts, len(classed), CLASSES)
    total = int(own.max()) + 1
    member = np.zeros((len(own), total))
    member[np.arange(len(own)), own] = 1
    grid = member.T @ counts @ member
    first_shape = total - SHAPES - 1
    if len(shipped) > len(classed):
        kinds = [first_shape + kind for _, kind, _ in shipped[len(classed):]]
        own = np.concatenate([own[:len(classed)], kinds, first_shape + np.arange(SHAPES + 1)]).astype(np.int64)
        names = [w for w, _, _ in shipped]
        own = assigned(documents, names, own, len(classed), min(CLASSES, len(classed)), grid, text)
        grid = class_bigrams(documents, names, own, total, text)
    plain = (grid.sum(axis=0) + 1) / (grid.sum() + total)
    steps = np.log10((grid + 20 * plain) / (grid.sum(axis=1, keepdims=True) + 20))
    tail_n, tail_words = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in sums:
        if r.shape < SHAPES:
            tail_n[r.shape], tail_words[r.shape] = r.n, r.words
    in_class = np.zeros(total)
    for i, (_, kind, n) in enumerate(shipped):
        in_class[own[i]] += n
        if own[i] < first_shape:
            tail_n[kind] -= n
            tail_words[kind] -= 1
    tail = np.log10(tail_n + tail_words + 1)
    known = {}
    for i, (word, kind, n) in enumerate(shipped):
        if own[i] < first_shape:
            known[word] = int(own[i]), float(np.log10(n / in_class[own[i]])), float(np.log10(n + 1))
        else:
            known[word] = first_shape + kind, float(np.log10(n + 1) - tail[kind]), float(np.log10(n + 1))
    return Model(tokens, distinct, known, steps, tail, first_shape, next((r.n for r in sums if r.shape == SHAPES), 0))


def _scored_in_task(documents: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """What a task knows of each text: counts, sums over shipped words, and its other words with how often each occurs."""
    names = pa.array(list(model.known), pa.large_binary())
    sent = np.array(list(model.known.values()), np.float64).reshape(-1, 3)
    shared = documents.sparkSession.sparkContext.broadcast((names, sent, model.steps, model.tail, model.first_shape, model.end_count))
    kind = documents.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, facts, steps, tail, first_shape, end_count = shared.value
        facts = np.vstack([facts, np.zeros((1, 3))])  # the last row is for words that were not sent
        row, at_end, end = TaskContext.get().partitionId() << 33, float(np.log10(end_count + 1)), len(steps) - 1
        for batch in slices(batches, "text"):
            words, counts, kinds = cut(batch.column("text").to_pylist())
            number, texts = numbered(words, known), batch.num_rows
            text_of, other = np.repeat(np.arange(texts), counts), number < 0
            classes = np.where(other, first_shape + kinds, facts[number, 0].astype(np.int64))
            path = with_ends(classes, counts, end)
            ends = np.cumsum(counts + 1)  # where each text's end stands; a step belongs to the text that it leads into
            into = np.searchsorted(ends, np.arange(1, len(path)), side="left")
            total = lambda of, values: np.bincount(of, values, texts)
            chance = total(into, steps[path[:-1], path[1:]]) + total(text_of, np.where(other, -tail[kinds], facts[number, 1]))
            plain = at_end + total(text_of, facts[number, 2])
            seen = int(end_count > 0) + total(text_of, ~other).astype(np.int64)
            rest = words.take(pa.array(np.flatnonzero(other))).dictionary_encode()
            size = max(len(rest.dictionary), 1)
            cells, times = np.unique(text_of[other] * size + rest.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc, word = np.divmod(cells, size)
            lists = pa.array(np.searchsorted(doc, np.arange(texts + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.arange(row, row + texts)), pa.array(counts.astype(np.int64) + 1), pa.array(seen), pa.array(plain), pa.array(chance),
                 pa.ListArray.from_arrays(lists, rest.dictionary.take(pa.array(word)).cast(pa.binary())), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64)))],
                ["key", "row", "n_tokens", "seen", "plain", "chance", "words", "times"])
            row += texts

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(score, f"key {kind}, row long, n_tokens long, seen long, plain double, chance double, words array<binary>, times array<bigint>")


def scores(documents: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each text, in log10, from a model of the training texts.

    Null text reads as empty: one token, the end. Null keys and repeated rows pass
    through, extra columns are ignored, an empty table gives an empty one. Without
    training texts every chance is one: both scores are zero.
    """
    words = written(vocabulary(training, text))
    model = fit(training, words, text)
    table = written(_scored_in_task(documents, model, key, text))
    others = table.select("row", F.explode(F.arrays_zip("words", "times")).alias("o")).select("row", F.col("o.words").alias("word"), F.col("o.times").alias("times"))
    looked = others.join(words.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more_seen"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    whole = table.select("key", "row", "n_tokens", "seen", "plain", "chance").join(looked, "row", "left").na.fill(0, ["more_seen"]).na.fill(0.0, ["more"])
    unit = float(np.log10(model.tokens + model.words + 1))
    base = F.col("plain") + F.col("more") - F.col("n_tokens") * F.lit(unit)
    return whole.select(
        F.col("key").alias(key), "n_tokens", (F.col("seen") + F.col("more_seen")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("chance") + F.col("more") if model.tokens else F.lit(0.0)).alias("score"))
