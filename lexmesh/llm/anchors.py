"""Near-duplicate fingerprints by anchor points of a covering code.

Two fingerprints of 64 bits that differ in at most ``3`` bits differ in at most one bit
in one of their halves. Each half of 32 bits is a word of the direct sum of the
binary Golay code (23 bits, covering radius 3), the Hamming code (7 bits, radius 1)
and 2 free bits: 2^18 anchors, and every word is within radius 4 of one, its home.
If a half of x and y differs in one bit, y is within 4 + 1 of the home of x. So each
fingerprint is put to every anchor within 5 of either half, 14.8 on average, and
at each anchor those at home are compared with all that are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import held
from lexmesh.session import written

THRESHOLD = 3
CELL = 1024
_RADIUS = 4
_SLIDE = 64
_GOLAY = 0b101011100011  # generator polynomial of the Golay code, a fixed value


def _syndromes() -> np.ndarray:
    """The syndrome, of 14 bits, of each of the 32 unit words."""
    out = []
    for i in range(23):  # x^i modulo the Golay polynomial
        rest = 1 << i
        for d in range(22, 10, -1):
            if rest >> d & 1:
                rest ^= _GOLAY << (d - 11)
        out.append(rest)
    out += [(i + 1) << 11 for i in range(7)]  # columns 1 to 7 of the Hamming check
    return np.array(out + [0, 0], np.uint32)


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error words of weight up to radius + 1 sorted by syndrome and weight, where each syndrome begins, and the units."""
    unit = _syndromes()
    levels = [(np.zeros(1, np.uint32), np.zeros(1, np.uint32), np.full(1, -1))]  # word, syndrome, highest bit
    for _ in range(_RADIUS + 1):
        word, mark, top = levels[-1]
        grown = [(word[top < p] | np.uint32(1 << p), mark[top < p] ^ unit[p], np.full(int((top < p).sum()), p)) for p in range(32)]
        levels.append(tuple(np.concatenate(x) for x in zip(*grown)))
    words, marks = (np.concatenate([level[k] for level in levels]) for k in (0, 1))
    weights = np.repeat(np.arange(len(levels)), [len(level[0]) for level in levels])
    order = np.lexsort((words, weights, marks))
    return words[order], np.searchsorted(marks[order], np.arange((1 << 14) + 1)), unit


def around(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for every anchor within radius + 1 of each word of 32 bits."""
    words, begins, unit = held("anchors", _table)
    mark = np.zeros(len(half), np.uint32)
    for bit in range(32):
        mark ^= np.where(half >> np.uint32(bit) & np.uint32(1), unit[bit], np.uint32(0))
    count = begins[mark + 1] - begins[mark]
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(half)), count)
    at = np.arange(len(row)) - first[row] + begins[mark][row]
    home = np.zeros(len(row), bool)
    home[first] = True  # of least weight, then least word
    return row, half[row] ^ words[at], home


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        for side in (0, 1):
            half = (prints >> np.uint64(32 * side)).astype(np.uint32)
            row, anchor, home = around(half)
            place = anchor.astype(np.int64) * 2 + side
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), batch.column("node").take(pa.array(row)), pa.array(prints[row].view(np.int64)), pa.array(home)],
                ["anchor", "node", "print", "home"])


def _forest(prints: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the boolean matrix joins, one less than there are nodes at most."""
    left, links = np.ones(len(nodes), bool), []
    for i in range(len(nodes)):
        if not left[i]:
            continue
        left[i], stack = False, [i]
        while stack:
            k = stack.pop()
            fresh = np.flatnonzero(near[k] & left)
            left[fresh] = False
            links += [(k, int(f)) for f in fresh]
            stack += fresh.tolist()
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in the cells of a partition sorted by cell; a cell holds ``2 * CELL`` rows or so."""
    kept: list[np.ndarray] = []

    def links(cell: np.ndarray, node: np.ndarray, bits: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[begins, len(cell)])
        size_of = np.repeat(sizes, sizes)
        left_of = size_of - (np.arange(len(cell)) - np.repeat(begins, sizes))  # rows to the cell's end, itself included
        pairs = []
        small = size_of <= _SLIDE
        for step in range(1, min(int(sizes.max(initial=1)), _SLIDE)):
            i = np.flatnonzero(small & (left_of > step))
            j = i + step
            hit = ((role[i] | role[j]) == 3) & (np.bitwise_count(bits[i] ^ bits[j]) <= THRESHOLD)
            pairs.append((node[i[hit]], node[j[hit]]))
        for b, n in zip(begins[sizes > _SLIDE], sizes[sizes > _SLIDE]):
            some, what = bits[b:b + n], role[b:b + n]
            near = np.bitwise_count(some[:, None] ^ some[None, :]) <= THRESHOLD
            near &= (what[:, None] | what[None, :]) == 3
            found = _forest(some, node[b:b + n], near)
            if found:
                x, y = np.array(found).T
                pairs.append((node[b + x], node[b + y]))
        u = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
        v = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
        both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1) if len(u) else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "node", "print", "role")]
        now[2] = now[2].view(np.uint64)  # numpy counts the bits of a negative number's absolute value
        now = [np.concatenate(x) for x in zip(kept, now)] if kept else now
        cut = int(np.searchsorted(now[0] == now[0][-1], True)) if len(now[0]) else 0
        if cut:
            yield links(*(x[:cut] for x in now))
        kept = [x[cut:] for x in now]
    if kept:
        yield links(*kept)


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links that connect all fingerprints differing in 3 bits or fewer, for rows (node, print) of distinct prints.

    An anchor with more than ``CELL`` rows is cut into a grid of cells, those at home
    against those there, so a task's memory is bounded and nothing is dropped. A large
    cell returns a spanning forest of its links, a small one the links themselves.
    """
    there = written(prints.mapInArrow(_replicate, "anchor long, node long, print long, home boolean"))
    sizes = there.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    cut = written(sizes.select("anchor", F.ceil(F.col("n") / CELL).cast("int").alias("cuts")))  # few anchors, or none
    dealt = there.join(cut, "anchor", "left").withColumn("parts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # Roles: 1 at home, 2 there. A row at home is also one of those there.
    at_home = F.when(F.col("home"), F.transform(others, lambda k: F.struct(own.alias("i"), k.alias("j"), F.lit(1).alias("role"))))
    guests = F.transform(others, lambda k: F.struct(k.alias("i"), own.alias("j"), F.lit(2).alias("role")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), 3).otherwise(2).alias("role")))
    cells = F.when(F.col("parts") == 1, single).otherwise(F.concat(F.coalesce(at_home, F.array().cast("array<struct<i:int,j:int,role:int>>")), guests))
    spread = dealt.select("anchor", "node", "print", F.explode(cells).alias("c")).select(
        F.xxhash64("anchor", "c.i", "c.j").alias("cell"), "node", "print", F.col("c.role").cast("byte").alias("role"))
    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = spread.repartition(count, "cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(_compare, "u long, v long").distinct()
