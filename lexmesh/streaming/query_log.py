"""Structured Streaming forms of the incremental jobs.

Sources are file streams, sinks are parquet folders. A job names its folder: the
checkpoint and the table lie there, so the next run reads only what is new. A batch is a
change of a keyed table: it rewrites the buckets of its keys alone, a repeated batch
gives the same table, and the state is one row per key.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.session import shared_folder
from lexmesh.sources.keyed import KeyedTable


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table folder read as a file stream; the batch reader gives the schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def daily_windows(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Entries and total value per day and branch; late entries are accepted up to ``delay``."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("rama"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    )


def _run(stream: DataFrame, run: str, key: list[str], mode: str) -> DataFrame:
    """Rows of each batch replace those of the same key; only the buckets that a batch touches are written."""
    table = KeyedTable(stream.sparkSession, f"{run}/table", key, stream.schema)

    def land(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)

    job = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/checkpoint")
        .trigger(availableNow=True).foreachBatch(land).start()
    )
    job.awaitTermination()
    return table.read()


def _own(spark: SparkSession, run: str | None) -> str:
    return run or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def daily_report(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """Read what is new in the log and return the whole report; ``run`` names the job's folder, a new one if not given."""
    log = _stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    table = _run(daily_windows(log), _own(spark, run), ["w", "rama"], "update")
    return table.select(F.date_format("w.start", "yyyy-MM-dd").alias("dia"), "rama", "n", F.round("total", 4).alias("total"))


def ingest_documents(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """Stream documents into a keyed table of content hashes; of an id that arrives again the newest batch counts, within a batch the greatest hash."""
    arrived = _stream(spark, folder, "documents").select("doc_id", "lang", F.md5("text").alias("hash"))
    return _run(arrived, _own(spark, run), ["doc_id"], "append").select("doc_id", "lang", "hash")
