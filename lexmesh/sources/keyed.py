"""A table with one row a key, kept in buckets of the key's hash; a change rewrites the buckets it touches and no other.

Every change writes a version: files of the touched buckets under ``version=N`` and, last, a
list of which version each bucket is now in. Readers follow the newest list, so they see a change whole or not at
all, and a change that is repeated gives the same table. Versions that neither of the two newest
lists names are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmesh.session import written

STAMP = "updated_at"
_BUCKET = "bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: StructType | None = None, buckets: int = 64) -> None:
        """``schema`` is needed to read a table to which nothing was written yet; ``buckets`` is fixed by the first change."""
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets

    def _path(self, tail: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{tail}")

    def _glob(self, pattern: str) -> list:
        path = self._path(pattern)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath() for f in found or []]

    def versions(self) -> list[int]:
        """Numbers of the lists that are whole, ascending."""
        return sorted(int(p.getParent().getName().split("=")[1]) for p in self._glob("list=*/_SUCCESS"))

    def _list(self, number: int) -> dict[int, int]:
        """bucket -> version; a row for each bucket that holds anything."""
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/list={number}").collect()}

    def places(self, before: int | None = None) -> dict[int, int]:
        """In which version each bucket is now, or was before that version."""
        numbers = [n for n in self.versions() if before is None or n < before]
        return self._list(numbers[-1]) if numbers else {}

    def _rows(self, places: dict[int, int]) -> DataFrame | None:
        if not places:
            return None
        paths = [f"{self.folder}/version={v}/{_BUCKET}={b}" for b, v in sorted(places.items())]
        return self.spark.read.option("basePath", self.folder).parquet(*paths).drop("version", _BUCKET)

    def read(self) -> DataFrame:
        """All rows, with the time of their last change in ``updated_at``."""
        found = self._rows(self.places())
        if found is not None:
            return found
        if self.schema is None:
            raise ValueError("an empty table needs a schema to be read")
        return self.spark.createDataFrame([], StructType([*self.schema.fields]).add(STAMP, "timestamp"))

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, number: int | None = None) -> list[int]:
        """Rows replace those of the same key; rows of a key beyond one are the caller's fault. Returns the buckets written.

        ``number`` names the change, so that a change that is made again (a stream's batch) is the same version.
        """
        return self._change(rows, number, removed=False)

    def delete(self, keys: DataFrame, number: int | None = None) -> list[int]:
        return self._change(keys.select(*self.key), number, removed=True)

    def _change(self, rows: DataFrame, number: int | None, removed: bool) -> list[int]:
        number = max(self.versions(), default=-1) + 1 if number is None else number
        places = self.places(before=number)
        rows = written(rows)  # read up to three times below: buckets, keys and rows
        new = rows.withColumn(_BUCKET, self.bucket_of())
        touched = [r.bucket for r in new.select(_BUCKET).distinct().collect()]  # no more than there are buckets
        held = self._rows({b: v for b, v in places.items() if b in touched})
        stamped = new.withColumn(STAMP, F.current_timestamp())
        if held is not None:
            keys = rows.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(self.key))).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(self.key)]
            stay = held.join(keys, same, "left_anti").withColumn(_BUCKET, self.bucket_of())
            stamped = stay if removed else stay.unionByName(stamped)
        if not removed or held is not None:
            # A bucket of a large table is written by several tasks: rows are spread by bucket and key.
            stamped.repartition(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets * 16))).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.folder}/version={number}")
        filled = {int(p.getName().split("=")[1]) for p in self._glob(f"version={number}/{_BUCKET}=*")} if not removed or held is not None else set()
        now = {b: v for b, v in places.items() if b not in touched} | {b: number for b in touched if b in filled}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list={number}")
        self._clear()
        return sorted(touched)

    def _clear(self) -> None:
        kept = self.versions()[-2:]
        named = {v for n in kept for v in self._list(n).values()} | set(kept)
        for pattern, wanted in (("version=*", named), ("list=*", set(kept))):
            for path in self._glob(pattern):
                number = int(path.getName().split("=")[1])
                if number not in wanted and number < kept[-1]:
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
