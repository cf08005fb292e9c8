"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % n


def held_out(key: str, n: int, rest: int) -> Column:
    """True where the remainder is ``rest``; a null key is never held out."""
    return F.coalesce(remainder(key, n) == rest, F.lit(False))


def lowest(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of least hash of the key, a little more than ``most`` of them, all if they are few: a sample that is cut where the rows are, after a count."""
    share = 1.2 * most / max(rows.count(), 1)
    return rows if share >= 1 else rows.where(F.xxhash64(key) <= int(-(1 << 63) + share * ((1 << 64) - 2048)))


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What this worker keeps under a name between tasks. It keeps one thing: workers are used again by other operators, whose things go."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts hold about ``most`` bytes, so that a task's memory is bounded by it and the longest text."""
    for batch in batches:
        at, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n) + 64
        if at < batch.num_rows:
            yield batch.slice(at)
    pa.default_memory_pool().release_unused()  # the worker is used again by tasks of other stages
