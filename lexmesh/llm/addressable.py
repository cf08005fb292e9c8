"""Token ids in directly addressable codes.

An id is split into chunks of a few bits, least first. Level 0 holds the first chunk
of every id, level 1 the second chunk of those ids that need one, and so on. A bit
per entry says whether the id goes on; a directory of counts, one for every 512 bits,
turns the position on one level into that on the next. Any token is read with one
look per level; no block is decoded.

On disk a store is a folder of Parquet files, written by Spark, so that a task that is
repeated leaves one copy. A row is one segment: consecutive documents with their
ids coded as above, about ``segment_tokens`` of them, more only for a longer document.
Rows are in ascending order of document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import slices
from lexmesh.llm.piece_encoder import encoder
from lexmesh.session import written

WIDTHS = (10, 6, 8, 8)
_STEP = 512
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, least bit first, without gaps."""
    if width == 8:
        return values.astype(np.uint8).tobytes()
    group = 8 // gcd(width, 8)  # so many values fill whole bytes, 64 bits at most
    rows = np.zeros((-(-len(values) // group), group), np.uint64)
    rows.reshape(-1)[:len(values)] = values
    whole = np.bitwise_or.reduce(rows << (np.arange(group, dtype=np.uint64) * np.uint64(width)), axis=1)
    return whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :group * width // 8].tobytes()[:(len(values) * width + 7) // 8]


def _unpack(data: memoryview, count: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width == 8:
        return raw[:count].astype(np.uint32)
    group = 8 // gcd(width, 8)
    size = group * width // 8
    rows = np.zeros((-(-count // group), 8), np.uint8)
    held = np.zeros(len(rows) * size, np.uint8)
    held[:min(len(raw), len(held))] = raw[:len(held)]
    rows[:, :size] = held.reshape(-1, size)
    values = rows.view("<u8") >> (np.arange(group, dtype=np.uint64) * np.uint64(width))
    return (values & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(-1)[:count]


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """Layout: the number of levels, then per level (entries, width), then chunks, bitmap, directory of each level."""
    rest, levels = ids.astype(np.uint32), []
    for width in widths:
        chunk, more = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_BITS[bitmap])]).astype(np.uint32)
        levels.append((len(rest), width, _pack(chunk, width), bitmap.tobytes(), ones[:-1:_STEP // 8].tobytes()))
        rest = more[goes_on]
        if not len(rest):
            break
    if len(rest):
        raise ValueError(f"an id does not fit in {sum(widths)} bits")
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<II", n, w) for n, w, *_ in levels)
    return head + b"".join(part for _, _, *parts in levels for part in parts)


class Codes:
    """A coded sequence: ``codes[i]`` is one token, ``codes.all()`` all of them."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        count, = struct.unpack_from("<I", view)
        at, self._levels = 4 + 8 * count, []
        for k in range(count):
            n, width = struct.unpack_from("<II", view, 4 + 8 * k)
            cuts = [at]
            for size in ((n * width + 7) // 8, (n + 7) // 8, 4 * -(-((n + 7) // 8) // (_STEP // 8))):
                cuts.append(cuts[-1] + size)
            self._levels.append((n, width, *(view[a:b] for a, b in zip(cuts, cuts[1:]))))
            at = cuts[-1]

    def __len__(self) -> int:
        return self._levels[0][0]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for _, width, chunks, bitmap, directory in self._levels:
            first, bit = divmod(i * width, 8)
            value |= (int.from_bytes(chunks[first:first + 5], "little") >> bit & (1 << width) - 1) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _STEP
            before = bitmap[block * _STEP // 8:i >> 3]
            last = bitmap[i >> 3] & (1 << (i & 7)) - 1
            i = struct.unpack_from("<I", directory, 4 * block)[0] + sum(b.bit_count() for b in before) + last.bit_count()
            shift += width
        return value

    def all(self) -> np.ndarray:
        deeper = None
        for n, width, chunks, bitmap, _ in reversed(self._levels):
            values = _unpack(chunks, n, width)
            if deeper is not None:
                goes_on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n, bitorder="little").astype(bool)
                values[goes_on] |= deeper << np.uint32(width)
            deeper = values
        return deeper


_SEGMENT = "part int, before long, n_tokens long, doc_ids array<bigint>, sizes array<bigint>, codes binary"


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, segment_tokens: int = 1 << 20,
          key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, in ascending order of key, each ended by ``end_id``.

    Texts are dealt by ranges of (key, hash of text), which splits a key that many rows
    share; a text is encoded once, after it has been dealt. Null keys come first, null
    text reads as empty, of equal keys the lesser text comes first, extra columns
    are ignored, an empty table gives a store without rows.
    """
    spark = documents.sparkSession

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal before
            ids, sizes = (np.concatenate(x) for x in zip(*held))
            row = [[part], [before], [len(ids)], [keys], [sizes.tolist()], [encode(ids)]]
            before += len(ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "before", "n_tokens", "doc_ids", "sizes", "codes"])

        for batch in slices(batches, "text"):
            held.append(ids_of.encode_ended(batch.column("text").to_pylist(), end_id))
            keys += batch.column("key").to_pylist()
            if sum(len(ids) for ids, _ in held) >= segment_tokens:
                yield close()
                keys, held = [], []
        if keys:
            yield close()

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    dealt.mapInArrow(segments, _SEGMENT).write.parquet(folder)


def _offsets(store: DataFrame) -> DataFrame:
    """(part, first): tokens in all parts before a part; one row for each task that wrote."""
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    running = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(running, F.lit(0)).alias("first"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, ids): each document with its ids, decoded, and the number of ids before it in the store."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = Codes(row["codes"]).all(), np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                cuts = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64))
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, cuts, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), packed.cast(pa.binary())], ["key", "start", "ids"])

    store = spark.read.parquet(folder)
    placed = store.join(written(_offsets(store)), "part").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "sizes", "codes")
    return placed.mapInArrow(documents, "key long, start long, ids binary")


def token(spark: SparkSession, folder: str, key: int, position: int) -> int:
    """One token of one document, addressed directly in its segment."""
    row = spark.read.parquet(folder).where(F.array_contains("doc_ids", key)).select(
        "codes", F.array_position("doc_ids", key).alias("at"), "sizes").first()
    if row is None or not 0 <= position < row.sizes[row.at - 1]:
        raise IndexError(f"document {key} has no token {position}")
    return Codes(bytes(row.codes))[sum(row.sizes[:row.at - 1]) + position]
