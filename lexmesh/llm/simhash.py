"""SimHash fingerprints of word shingles and the groups of near-equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmesh.llm import anchors
from lexmesh.llm.common import slices
from lexmesh.llm.components import components
from lexmesh.session import written

_BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if it is set in over half the hashes of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split() if text else []  # on bytes: A-Z only, and the six ASCII spaces
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        some = hashes[at:at + _BLOCK]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print): print is the fingerprint as a signed long. Null text reads as empty, whose fingerprint is zero."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], ["key", "print"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(of, "key long, print long")


def distinct(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, but of each group of linked fingerprints only one: that of the least key, of rows that share it that of the least text hash.

    Decided by row: rows that share a key but whose texts are not near stay apart, repeated rows leave one.
    Rows with a null key are no one's duplicates. Null text reads as empty; columns of any name pass through.
    """
    mark = "_"
    while any(c.startswith(mark) for c in documents.columns):
        mark += "_"
    print_, row = f"{mark}print", f"{mark}row"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(t) for t in batch.column(text).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, print_])

    schema = StructType([*documents.schema.fields, StructField(print_, LongType())])
    rows = written(documents.mapInArrow(add, schema).withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text"), F.col(row).alias("row"))
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(print_).alias("print"), order.alias("o"))
    prints = written(keyed.groupBy("print").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n")))
    roots = components(anchors.links(prints.select(F.col("print").alias("node"), "print")))
    grouped = written(prints.join(roots.withColumnRenamed("u", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    several = grouped.groupBy("root").agg(F.min("o").alias("first"), F.sum("n").alias("n")).where(F.col("n") > 1)
    first = written(grouped.join(several.select("root", "first"), "root").select("print", F.col("first.row").alias("first")))
    gone = written(keyed.join(first, "print").where(F.col("o.row") != F.col("first")).select(F.col("o.row").alias(row)))
    return rows.join(gone, row, "left_anti").select(*documents.columns)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each row: the least key reachable by links of 3 differing bits or fewer.

    Equal fingerprints are one node, so copies are never paired; links are found at the
    anchors of a covering code (``anchors``). Null text reads as empty. A row whose key
    is null can name no component: it gets its fingerprint and the component of its
    keyed fellows, null if there are none. Repeated rows each give a row, extra columns
    are ignored, an empty table gives an empty one.
    """
    rows = written(fingerprints(documents, key, text))
    nodes = written(rows.where(F.col("key").isNotNull()).groupBy("print").agg(F.min("key").alias("node")))
    roots = components(anchors.links(nodes.select("node", "print")))
    named = written(nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select(
        "print", F.coalesce("root", "node").alias("component_id")))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(named, "print", "left").select(F.col("key").alias(key), digits.alias("fingerprint"), "component_id")
