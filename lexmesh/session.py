"""Session helpers: sane defaults for tests and one shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexmesh")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local session,
    where driver and executors share one machine, may fall back to a new
    temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    cached = getattr(spark, "_lexmesh_folder", None)
    if cached is None:
        cached = tempfile.mkdtemp(prefix="lexmesh-")
        spark._lexmesh_folder = cached
    return cached


def written(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and read them back.

    This cuts lineage in a way that outlives lost executors, and the scan that
    follows knows its true size, so Catalyst broadcasts it only when the bytes
    on disk are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """Rows dealt by a key to tasks enough that ``most`` of ``rows`` fall to each, so that a task's memory does not grow with the input.

    ``rows`` counts what the task will hold, which may be more than the rows dealt.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), key)


def unsent(df: DataFrame) -> DataFrame:
    """Rows that a join must not send whole to every task.

    For tables that grow with the input: Catalyst takes the bytes of compressed columns for their size, which may be a
    hundredth of what rows made of them take on the driver, and would broadcast them.
    """
    return df.hint("merge")
