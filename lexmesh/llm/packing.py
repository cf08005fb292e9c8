"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of its documents' token ids. Every window of ``window`` tokens
takes from each queue as many tokens as its target share and its deficit allow;
what a queue was owed or given too much is carried to the next window. Shares are
whole numbers of tokens in a cycle of ``cycle`` windows, so the deficits after a cycle
are those before it, and the allotment of any window is known without walking
through those before it. Tasks on different partitions so carry the same deficits.
When a queue runs empty, a new phase begins for the others with their deficits.

The driver sees one total per source; texts, ids and pieces stay with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import slices
from lexmesh.llm.piece_encoder import encoder, id_type
from lexmesh.session import written

NO_SOURCE = "\u0000"


@dataclass
class Phase:
    """Windows first .. first + count - 1, in which the same queues are served.

    ``done``: tokens of each source before it; ``quota``: a source's tokens per cycle;
    ``owed``: the deficits it begins with; ``live``: the queues that are not empty. What a
    cycle's windows take is worked out where it is needed, not sent.
    """

    first: int
    count: int
    done: np.ndarray
    quota: np.ndarray
    owed: np.ndarray
    live: np.ndarray
    window: int
    cycle: int
    only: bool = False  # one window in which a queue runs empty; its quota is what it takes

    @cached_property
    def cuts(self) -> np.ndarray:
        """(cycle + 1, sources): tokens of each source before each window of a cycle."""
        if self.only:
            return np.array([np.zeros_like(self.quota), self.quota])
        return _cycle(self.owed.copy(), self.quota, self.cycle, self.window, self.live)


def _cycle(owed: np.ndarray, quota: np.ndarray, cycle: int, window: int, live: np.ndarray) -> np.ndarray:
    """The windows of one cycle while no queue runs empty; ``owed`` is updated in place."""
    cuts, most = [np.zeros_like(quota)], np.where(live, window, 0)
    for _ in range(cycle):
        cuts.append(cuts[-1] + _serve(owed, quota, cycle, window, most))
    return np.array(cuts)


def _whole(shares: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers in proportion to the shares, with the given sum; every positive share gets one at least where the sum allows it."""
    active = shares > 0
    out = np.zeros(len(shares), np.int64)
    spare = total - int(active.sum())
    out[active] = spare >= 0
    exact = shares / shares.sum() * max(spare, 0 if spare >= 0 else total)
    if spare < 0:
        exact = shares / shares.sum() * total
        out[:] = 0
    floor = np.floor(exact).astype(np.int64)
    out += floor
    left = total - int(out.sum())
    order = np.lexsort((np.arange(len(shares)), floor - exact))
    order = order[active[order]]
    for i in range(left):
        out[order[i % len(order)]] += 1
    return out


def _serve(deficit: np.ndarray, quota: np.ndarray, cycle: int, window: int, left: np.ndarray) -> np.ndarray:
    """Tokens of each source in the next window; ``deficit`` (in 1 / cycle tokens) is updated in place."""
    deficit += quota
    take = np.minimum(np.maximum(deficit // cycle, 0), left)
    over = int(take.sum()) - window
    while over:  # the most overdrawn give tokens back, or the best owed that have some left get them
        able = np.flatnonzero(take > 0 if over > 0 else take < left)
        if not len(able):
            break
        owed = (deficit - take * cycle)[able]
        count = min(abs(over), len(able))
        chosen = able[np.argsort(owed if over > 0 else -owed, kind="stable")[:count]]
        step = 1 if over > 0 or count < len(able) else max(1, min(-over // count, int((left - take)[chosen].min())))
        take[chosen] += -step if over > 0 else step
        over += -step * count if over > 0 else step * count
    deficit -= take * cycle
    return take


class Schedule:
    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int, cycle: int) -> None:
        left = totals.astype(np.int64).copy()
        done = np.zeros_like(left)
        deficit = np.zeros_like(left)
        self.window, self.phases, first = window, [], 0
        while left.sum() > 0:
            live = left > 0
            if (~live).any() and deficit[~live].any():  # what empty queues were owed goes to the largest live one
                deficit[int(np.argmax(np.where(live, shares, -1)))] += int(deficit[~live].sum())
                deficit[~live] = 0
            quota = _whole(np.where(live, np.maximum(shares, 1e-12), 0), window * cycle)
            opening, owed = deficit.copy(), deficit.copy()
            table = _cycle(owed, quota, cycle, window, live)
            repeats = table[-1] > 0
            full = int((left[repeats] // table[-1][repeats]).min()) if repeats.any() and (owed == deficit).all() else 0
            rest = left - full * table[-1]
            fits = (table <= rest).all(axis=1)
            part = int(np.argmin(fits)) - 1 if not fits.all() else cycle if full == 0 else 0
            if full or part:
                count = full * cycle + part
                self.phases.append(Phase(first, count, done.copy(), quota, opening, live, window, cycle))
                taken = full * table[-1] + table[part]
                for row in range(part):
                    deficit += quota - (table[row + 1] - table[row]) * cycle
                done, left, first = done + taken, left - taken, first + count
            if left.sum() > 0:  # the window in which a queue runs empty
                take = _serve(deficit, quota, cycle, window, left.copy())
                self.phases.append(Phase(first, 1, done.copy(), take.copy(), deficit, live, window, 1, only=True))
                done, left, first = done + take, left - take, first + 1
        self.windows = first
        self._first = np.array([p.first for p in self.phases], np.int64)
        self._done = np.array([p.done for p in self.phases], np.int64).reshape(len(self.phases), len(totals))

    def pieces(self, source: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in the queue, length, window, offset in the window) of spans of a queue, cut at window ends."""
        spans = np.flatnonzero(sizes > 0)
        begin, end = self._of(source, starts[spans]), self._of(source, starts[spans] + sizes[spans] - 1)
        count = end - begin + 1
        doc = np.repeat(spans, count)
        window = np.repeat(begin, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        low, high, room = self._place(source, window)
        start = np.maximum(low, starts[doc])
        length = np.minimum(high, starts[doc] + sizes[doc]) - start
        kept = length > 0
        return doc[kept], start[kept], length[kept], window[kept], (room + start - low)[kept]

    def _of(self, source: int, positions: np.ndarray) -> np.ndarray:
        """The window of each position of a queue."""
        out = np.empty(len(positions), np.int64)
        at = np.searchsorted(self._done[:, source], positions, side="right") - 1
        for k in np.unique(at):
            phase, mine = self.phases[k], at == k
            rounds, rest = np.divmod(positions[mine] - phase.done[source], phase.cuts[-1, source])
            out[mine] = phase.first + rounds * phase.cycle + np.searchsorted(phase.cuts[:, source], rest, side="right") - 1
        return out

    def _place(self, source: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A queue's first and last position in each window, and the offset at which it begins there."""
        low, high, room = (np.empty(len(windows), np.int64) for _ in range(3))
        at = np.searchsorted(self._first, windows, side="right") - 1
        for k in np.unique(at):
            phase, mine = self.phases[k], at == k
            rounds, row = np.divmod(windows[mine] - phase.first, phase.cycle)
            base = phase.done[source] + rounds * phase.cuts[-1, source]
            low[mine], high[mine] = base + phase.cuts[row, source], base + phase.cuts[row + 1, source]
            room[mine] = (phase.cuts[1:, :source] - phase.cuts[:-1, :source]).sum(axis=1)[row]
        return low, high, room


def _encoded(documents: DataFrame, tokenizer: str, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """Ids of each document with the tokens of its source before it in the same task."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text"):
            ids, sizes = ids_of.encode_ended(batch.column("text").to_pylist(), end_id)
            named = batch.column("source").dictionary_encode()
            source, names = named.indices.to_numpy(), named.dictionary.to_pylist()
            order = np.argsort(source, kind="stable")
            ends, first = np.cumsum(sizes[order]), np.searchsorted(source[order], np.arange(len(names)))
            start = ends - sizes[order]
            before = np.empty(len(sizes), np.int64)
            before[order] = start - start[first][source[order]] + np.array([seen.get(n, 0) for n in names], np.int64)[source[order]]
            for name, total in zip(names, np.bincount(source, sizes, len(names)).astype(np.int64).tolist()):
                seen[name] = seen.get(name, 0) + total
            cuts = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * ids.itemsize)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, cuts, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("source"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(sizes), packed],
                ["key", "source", "part", "before", "size", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(encode, f"key {kind}, source string, part int, before long, size long, ids binary"))


def pack(documents: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, shares: dict[str, float] | None = None,
         cycle: int = 64, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every document's ids, each in one window.

    ``ids`` are unsigned little-endian 32-bit. All windows but the last are full. Targets
    are ``shares`` by source, or each source's part of all tokens; a source without a share
    comes when the others have run empty. Null text reads as empty and gives its end
    id alone, null sources form a queue of their own, null keys and repeated rows are
    packed like any other, extra columns are ignored, an empty table gives no pieces.
    """
    rows = _encoded(documents, tokenizer, end_id, key, text, source)
    by_part = rows.groupBy("source", "part").agg(F.sum("size").alias("total"))
    ahead = F.sum("total").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = written(by_part.select("source", "part", "total", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    queues = {r.source: r.total for r in places.groupBy("source").agg(F.sum("total").alias("total")).collect()}  # a row per source
    names = sorted(queues)
    totals = np.array([queues[n] for n in names], np.int64)
    aims = totals.astype(float) if shares is None else np.array([float(shares.get(n, 0.0)) for n in names])
    schedule = Schedule(totals, aims, window, cycle)
    number = {n: i for i, n in enumerate(names)}
    width = id_type(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            sizes, starts = batch.column("size").to_numpy(), batch.column("start").to_numpy()
            queue = np.array([number[n] for n in batch.column("source").to_pylist()], np.int64)
            found = []
            for q in np.unique(queue):
                mine = np.flatnonzero(queue == q)
                doc, *rest = schedule.pieces(int(q), starts[mine], sizes[mine])
                found.append((mine[doc], *rest))
            doc, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc))  # then the pieces lie as the ids do
            doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), width).astype("<u4")
            cuts = pa.py_buffer((4 * np.concatenate([[0], np.cumsum(length)])).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(length), [None, cuts, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(doc)), pa.array(start - starts[doc]), pa.array(length), packed, pa.array(sizes[doc]), pa.array(sequence), pa.array(offset)],
                ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = documents.schema[key].dataType.simpleString()
    placed = rows.join(places.select("source", "part", "ahead"), ["source", "part"]).select(
        "key", "source", (F.col("ahead") + F.col("before")).alias("start"), "size", "ids")
    found = placed.mapInArrow(cut, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("key", key)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): each window put together, padded to ``window`` unless its length is a power of two."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    size = F.sum("length")
    whole = pieces.groupBy("sequence_id").agg(F.array_join(F.transform(parts, F.hex), "").alias("digits"), size.alias("n_tokens"))
    pad: Column = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(window - F.col("n_tokens")).cast("int")
    one = F.lit(pad_id.to_bytes(4, "little").hex().upper())
    return whole.select("sequence_id", F.unhex(F.concat("digits", F.repeat(one, pad))).alias("ids"), "n_tokens")
