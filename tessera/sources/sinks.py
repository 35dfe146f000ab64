"""Keyed, append-only and dead-letter sinks on versioned parquet folders.

A version is written whole before the pointer moves to it, so a failed write leaves the last version in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sync import upsert


class VersionedTable:
    """``folder/v=N`` holds version N; readers take the largest that is complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self.fs.exists(self.path):
            return 0
        found = [s.getPath() for s in self.fs.listStatus(self.path)]
        done = [p for p in found if p.getName().startswith("v=") and self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max([0, *(int(p.getName()[2:]) for p in done)])

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.folder}/v={v}") if v else None

    def write(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v={v}")
        return v

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        old = self.read()
        new = new.dropDuplicates(keys)
        return self.write(new if old is None else upsert(old, new, keys))

    def delete(self, ids: DataFrame, keys: list[str]) -> int:
        return self.write(self.read().join(ids.select(*keys), keys, "left_anti"))


def vectors_of_size(points: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Fails the job on a vector of another length."""
    return points.withColumn(column, F.when(F.size(column) == dims, F.col(column)).otherwise(F.raise_error(F.lit(f"vector length is not {dims}"))))


def append_events(table: VersionedTable, events: DataFrame, key: str = "idempotency_key") -> int:
    """Append rows whose key is new; rows without a key are always taken."""
    old = table.read()
    keyed, free = events.where(F.col(key).isNotNull()).dropDuplicates([key]), events.where(F.col(key).isNull())
    if old is not None:
        keyed = keyed.join(old.select(key), key, "left_anti")
    parts = [keyed.select(*events.columns), free] + ([old] if old is not None else [])
    return table.write(reduce(DataFrame.unionByName, parts))


def with_dead_letters(parsed: DataFrame, required: str, good: VersionedTable, bad: VersionedTable):
    """A ``foreachBatch`` writer: rows that did not parse go to a side table with their reason, the rest to the main one.

    A batch that comes again after a failure is dropped by its number.
    """

    def write(df: DataFrame, batch: int) -> None:
        for table, part in ((good, df.where(F.col(required).isNotNull())), (bad, df.where(F.col(required).isNull()).select("raw", F.lit("parse error").alias("error")))):
            old = table.read()
            part = part.withColumn("batch", F.lit(batch))
            table.write(part if old is None else old.where(F.col("batch") != batch).unionByName(part))

    return parsed.writeStream.foreachBatch(write)


def backfill(old: DataFrame, computed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fill nulls of some columns from computed rows."""
    c = computed.select(*keys, *[F.col(x).alias(f"_{x}") for x in columns])
    j = old.join(c, keys, "left")
    return j.withColumns({x: F.coalesce(x, f"_{x}") for x in columns}).drop(*[f"_{x}" for x in columns])
