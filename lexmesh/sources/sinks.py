"""Writers: partitioned folders per norm type, JSON exports and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import fold_accents


def write_by_kind(norms: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per norm type; rows are spread by type and id, so a type that holds
    most norms is written by many tasks."""
    spread = norms.withColumn("tipo", F.lower(fold_accents(F.col("tipo"))))
    spread.repartition("tipo", F.pmod(F.xxhash64("id_norma"), F.lit(32))).write.mode(mode).partitionBy("tipo").format(fmt).save(path)


def file_name(kind, number, year):
    """Column with the file stem of a norm: type, number and, when known, year."""
    stem = F.concat_ws("_", F.lower(fold_accents(kind)), F.regexp_replace(number, r"[^0-9A-Za-z]+", "-"))
    return F.when(year.isNotNull(), F.concat_ws("_", stem, year.cast("string"))).otherwise(stem)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_edges(edges: DataFrame, path: str, buckets: int, table: str) -> None:
    """Edge table bucketed by source, so that joins on the source need no shuffle."""
    edges.write.mode("overwrite").option("path", path).bucketBy(buckets, "src").sortBy("src").saveAsTable(table)
