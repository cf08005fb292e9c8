"""Where many terms occur in many texts: one walk over each text finds all of them.

Terms are looked up by hashes of their first and last signs, for all places of many texts at once, so a text is
read once however many terms there are. Terms reach the tasks in parts of bounded size. Positions are those of the text itself, so
context can be cut from it and spans can be compared with other spans.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms in one part.
PART_BYTES = 32 << 20
#: Signs that are hashed at once.
CHUNK = 1 << 18
#: A sign of one of these kinds beside a term makes it part of a longer word.
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0x100)))
_LATEST: list = [None, None]  # the terms this worker looked up last, and the part it was made of


def lowered(text: str) -> str:
    """Lower case, sign by sign, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word_sign(c: str) -> bool:
    return c.isalnum() or c == "_"


class Lookup:
    """Finds terms in lower-cased texts, many texts at once. ``borders``: None, ``"letters"`` or ``"words"``, what may not flank a term.

    Terms are kept by length and by the hashes of their first and last signs, the largest power of two up to 16 of them. Such
    hashes are made for all places, each from two of half the length. Places whose hash is unknown go first; where both
    hashes are those of a term, its signs are compared. It takes some 200 bytes a term.
    """

    _FACTORS = {2: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 8: 0x165667B19E3779F9, 16: 0xD6E8FEB86659FD93}
    _BOTH, _MIX = np.uint64(0x27D4EB2F165667C5), np.uint64(0x9FB21C651E98DF25)

    def __init__(self, forms: list[str], borders: str | None) -> None:
        known = frozenset(LETTERS)
        self._flanks = {None: None, "letters": known.__contains__, "words": _word_sign}[borders]
        self.forms = pa.array(forms, pa.string())
        self._lengths = np.fromiter(map(len, forms), np.int64, len(forms))
        self._longest = int(self._lengths.max(initial=0))
        self._offsets = np.cumsum(self._lengths) - self._lengths
        self._signs = self._coded("".join(forms))
        sizes = np.int64(1) << np.minimum(np.log2(np.maximum(self._lengths, 1)).astype(np.int64), 4)
        self._known: dict[int, tuple] = {}
        for size, here in self._hashes(self._signs):
            ids = np.flatnonzero(sizes == size)
            if not len(ids):
                continue
            first, last = here[self._offsets[ids]], here[self._offsets[ids] + self._lengths[ids] - size]
            keys = first * self._BOTH + last
            by_length = []
            for length in np.unique(self._lengths[ids]).tolist():
                mine = np.flatnonzero(self._lengths[ids] == length)
                mine = mine[np.argsort(keys[mine], kind="stable")]
                by_length.append((length, keys[mine], ids[mine], *self._marked(keys[mine])))
            self._known[size] = *self._marked(first), by_length

    def lengths(self, terms: np.ndarray) -> list[int]:
        return self._lengths[terms].tolist()

    @staticmethod
    def _coded(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @classmethod
    def _marked(cls, hashes: np.ndarray) -> tuple[np.uint64, np.ndarray]:
        shift = 64 - min(24, max(8, (16 * len(hashes)).bit_length()))
        marks = np.zeros(1 << (64 - shift), bool)
        marks[(hashes * cls._MIX) >> np.uint64(shift)] = True
        return np.uint64(shift), marks

    @classmethod
    def _hashes(cls, signs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, hash of that many signs from each place); of places too near the end there is none."""
        here, size = signs.astype(np.uint64), 1
        while True:
            yield size, here
            size *= 2
            if size > 16 or len(here) <= size // 2:
                return
            here = here[:-(size // 2)] * np.uint64(cls._FACTORS[size]) + here[size // 2:]

    def _places(self, signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, term) of all occurrences, those of one term in their order."""
        for size, here in self._hashes(signs):
            shift, marks, by_length = self._known.get(size, (0, None, ()))
            at = np.flatnonzero(marks[(here * self._MIX) >> shift]) if len(by_length) else None
            for length, keys, ids, shift, marks in by_length:
                a = at[:np.searchsorted(at, len(signs) - length, "right")]
                wanted = here[a] * self._BOTH + here[a + (length - size)]
                some = marks[(wanted * self._MIX) >> shift]
                a, wanted = a[some], wanted[some]
                low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                many = high - low
                a, low = np.repeat(a, many), np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                term, signs_of, step = ids[low], np.arange(length), max(1, (1 << 20) // length)
                same = [(signs[a[k:k + step, None] + signs_of] == self._signs[self._offsets[term[k:k + step], None] + signs_of]).all(axis=1) for k in range(0, len(a), step)]
                if same:
                    same = np.concatenate(same)
                    yield a[same], term[same]

    def _within(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        signs, steps = self._coded("".join(texts)), []
        # A very long text is read in stretches that reach over what follows by the longest term.
        for begin in range(0, max(1, len(signs)), CHUNK * 4):
            for a, term in self._places(signs[begin:begin + CHUNK * 4 + self._longest - 1]):
                mine = a < CHUNK * 4
                steps.append((a[mine] + begin, term[mine]))
        none = np.zeros(0, np.int64)
        a, term = (np.concatenate(x) for x in zip(*steps)) if steps else (none, none)
        which = np.searchsorted(begins + lengths, a, "right")
        start, length = a - begins[which], self._lengths[term]
        sound = start + length <= lengths[which]
        if self._flanks:
            flanked = lambda w, s, e: bool(s and self._flanks(texts[w][s - 1]) or e < len(texts[w]) and self._flanks(texts[w][e]))
            sound &= ~np.array([ok and flanked(w, s, s + n) for ok, w, s, n in zip(sound.tolist(), which.tolist(), start.tolist(), length.tolist())], bool)
        which, term, start, length = which[sound], term[sound], start[sound], length[sound]
        order = np.lexsort((start, term, which))
        which, term, start, length = which[order], term[order], start[order], length[order]
        fresh = np.ones(len(which), bool)
        fresh[1:] = (which[1:] != which[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(which)))
        close = np.flatnonzero(~fresh[1:] & (start[1:] - start[:-1] < length[1:])) + 1
        for group in np.unique(np.searchsorted(first, close, "right") - 1).tolist():  # overlaps with an earlier one that counts don't count
            end, n, size = -1, 0, int(length[first[group]])
            for s in start[first[group]:first[group] + counts[group]].tolist():
                if s >= end:
                    end, n = s + size, n + 1
            counts[group] = n
        return which[first], term[first], counts, start[first]

    def find(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, term, count, start of the first) of each term in each text, in blocks; occurrences of one term that overlap an earlier one of it don't count."""
        begin, size = 0, 0
        for end in range(1, len(texts) + 1):
            size += len(texts[end - 1])
            if size >= CHUNK or end == len(texts):
                which, *more = self._within(texts[begin:end])
                yield which + begin, *more
                begin, size = end, 0


def parts(forms: DataFrame, most: int = PART_BYTES) -> Iterator[list[str]]:
    """Distinct non-empty lower-cased forms (column ``form``) in lists of about ``most`` bytes."""
    held, size = [], 0
    for row in forms.where(F.length("form") > 0).select("form").distinct().toLocalIterator():
        held.append(lowered(row.form))
        size += len(row.form) + 16
        if size >= most:
            yield sorted(set(held))
            held, size = [], 0
    if held:
        yield sorted(set(held))


def occurrences(texts: DataFrame, forms: DataFrame, keep: list[str], text: str = "text", borders: str | None = "letters", margin: int | None = 30,
                most: int = PART_BYTES) -> DataFrame:
    """(keep..., form, n, start, context): one row for each text and form that occurs in it, case apart.

    ``start`` is the place of the first occurrence, from 0, and ``context`` that occurrence with
    ``margin`` signs on both sides, or null without a margin. Null texts hold nothing; empty forms are nowhere.
    Each part of the forms is one pass over the texts; nothing is shuffled.
    """
    spark = texts.sparkSession
    rows = texts.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kinds}, form string, n long, start long, context string"
    out = spark.createDataFrame([], schema)
    for part in parts(forms, most):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def walk(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            if _LATEST[0] != name:
                _LATEST[:] = None, None  # the one before goes first
                _LATEST[:] = name, Lookup(shared.value, borders)
            finder = _LATEST[1]
            for batch in batches:
                said = [whole or "" for whole in batch.column(batch.num_columns - 1).to_pylist()]
                for which, term, counts, start in finder.find([lowered(whole) for whole in said]):
                    at, form = pa.array(which), finder.forms.take(pa.array(term))
                    columns = [batch.column(k).take(at) for k in range(batch.num_columns - 1)]
                    context = pa.nulls(len(which), pa.string()) if margin is None else pa.array(
                        [said[w][max(0, s - margin):s + n + margin] for w, s, n in zip(which.tolist(), start.tolist(), finder.lengths(term))], pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, form, pa.array(counts), pa.array(start), context], [*keep, "form", "n", "start", "context"])

        out = out.unionByName(rows.mapInArrow(walk, schema))
    return out


# Signs that a pattern for either case takes for a Latin letter although their lower case is another sign or two.
_ODD = "\u017f\u212a\u0130\u0131"


def _places(pattern: re.Pattern, leads: tuple[str, ...], whole: str, low: str) -> Iterator[re.Match]:
    """What ``finditer`` gives for a pattern whose matches all begin with one of some lower-case strings; only there it is tried."""
    starts = set()
    for lead in leads:
        at = low.find(lead)
        while at >= 0:
            starts.add(at)
            at = low.find(lead, at + 1)
    end = 0
    for start in sorted(starts):
        if start >= end and (m := pattern.match(whole, start)):
            yield m
            end = m.end()


def matched(texts: DataFrame, patterns: dict[str, str], keep: list[str], text: str = "text", margin: int = 50, leads: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(keep..., kind, start, end, groups array<string>, context): every match of every pattern, case apart, in whole texts.

    ``kind`` names the pattern; ``groups`` are its groups, null where one took no part; places count
    from 0; ``context`` is the match with ``margin`` signs on both sides. Null texts hold nothing. ``leads`` tells
    what each match of a pattern begins with, in lower case, so that it need not be tried everywhere.
    """
    rows = texts.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, re.compile(p, re.IGNORECASE), (leads or {}).get(name)) for name, p in patterns.items()]
        for batch in batches:
            index, found = [], []
            for i, whole in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not whole:
                    whole = ""
                low = None if any(sign in whole for sign in _ODD) else whole.lower()
                for name, pattern, known in compiled:
                    for m in pattern.finditer(whole) if known is None or low is None else _places(pattern, known, whole, low):
                        index.append(i)
                        found.append((name, m.start(), m.end(), list(m.groups()), whole[max(0, m.start() - margin):m.end() + margin]))
            if found:
                at = pa.array(index, pa.int64())
                columns = [batch.column(k).take(at) for k in range(batch.num_columns - 1)]
                types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, t) for x, t in zip(zip(*found), types)], [*keep, "kind", "start", "end", "groups", "context"])

    return rows.mapInArrow(find, f"{kinds}, kind string, start long, end long, groups array<string>, context string")


def following(left: DataFrame, right: DataFrame, keep: list[str], reach: int) -> DataFrame:
    """Each row of ``left`` (keep..., start, ...) with the first of ``right`` (keep..., start, end, ...) that lies within ``reach`` signs from its start.

    Columns of the right side but ``keep`` become one struct, ``next``; rows without one go. Both sides
    meet in stretches of ``reach`` signs, a left row in its own and in the next, so the join is one on equal
    keys and no text's matches are all paired.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    near = left.withColumn("_cell", F.explode(F.array(cell("start"), cell("start") + 1)))
    there = right.select(*keep, F.struct(*(c for c in right.columns if c not in keep)).alias("next"), cell("start").alias("_cell"))
    pairs = near.join(there, [*keep, "_cell"]).where((F.col("next.start") >= F.col("start")) & (F.col("next.end") <= F.col("start") + reach))
    own = [c for c in left.columns if c not in keep]
    return pairs.groupBy(*keep, *own).agg(F.min_by("next", F.struct("next.start", "next.end")).alias("next"))
