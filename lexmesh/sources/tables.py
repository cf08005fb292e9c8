"""Parquet table scans. Columns are named so that pruning reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of costly texts that one task is given.
TASK_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt over all cores, in tasks of about ``rows`` at most, when the scan leaves most of them to few tasks.

    A small file is one task, and of the splits of a large one only those that hold the middle of a
    row group get rows, so splits are no measure: the rows of each task are counted, which reads the files' footers
    alone. An even scan is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    if not held.all or held.most <= 2 * min(held.all / cores, rows):
        return df
    return df.repartition(max(cores, -(-held.all // rows)))


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are costly to parse."""
    return spread(table(spark, folder, name, *columns))
