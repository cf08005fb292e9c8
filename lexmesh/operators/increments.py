"""Incremental change: diffs, upserts, rebuilds and resumable work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_diff(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """(id, cambio): new ids, outdated ones (downloaded, hash differs, null-safe) and those gone."""
    new = snapshot.select("id", F.col("hash").alias("h_new"), F.lit(True).alias("in_new"))
    old = state.select("id", F.col("hash").alias("h_old"), "estado", F.lit(True).alias("in_old"))
    both = new.join(old, "id", "full")
    changed = ~F.col("h_new").eqNullSafe(F.col("h_old")) & (F.col("estado") == "downloaded")
    kind = (
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "gone").when(changed, "outdated"))
    return both.select("id", kind.alias("cambio")).where(F.col("cambio").isNotNull())


def content_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Ids seen before whose hash changed."""
    return current.join(previous.withColumnRenamed("hash", "antes"), "id").where(
        F.col("hash") != F.col("antes")).select("id", "antes", F.col("hash").alias("ahora"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Last writer wins by key: the newest new row, else the old row."""
    others = [c for c in old.columns if c not in key and c != "seq"]
    merged = old.withColumn("layer", F.lit(0)).unionByName(new.withColumn("layer", F.lit(1)))
    return merged.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("layer", "seq")).alias("r")).select(*key, "r.*")


def rebuild(table: DataFrame, touched: DataFrame, replacement: DataFrame, key: list[str]) -> DataFrame:
    """Delete the rows of touched keys, then insert their replacement."""
    return table.join(touched.select(*key).distinct(), key, "left_anti").unionByName(replacement)


def pending(wanted: DataFrame, done: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """Work still to do, most important first (a top-k report)."""
    return wanted.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(top)


def merge_metadata(base: Column, patch: Column) -> Column:
    """Shallow merge of string maps, the patch wins, null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    patch = F.coalesce(patch, empty)
    kept = F.map_filter(F.coalesce(base, empty), lambda k, _v: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def json_slice(text: Column) -> Column:
    """From the first opening to the last closing brace, null when there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
