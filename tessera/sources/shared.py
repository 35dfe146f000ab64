"""The folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager
from typing import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once to the shared folder (in folders of the columns ``by``) and read back, for plans that use it several times; a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-stored/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when their query ends; Spark else keeps them until the driver happens to collect their plans."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def clear_stored(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder (stored tables and indexes, work tables, streams), once no result that reads them is needed."""
    app = spark.sparkContext.applicationId
    for root in ("tessera-stored", "tessera-work", "tessera-streams"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{root}/{app}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    FOUND.clear()


#: What ``kept`` has built in this application, by folder.
FOUND: dict = {}


def kept(source: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The folder of something derived from the files of ``source``: built by the first caller of an application, and found again as long as no file changes."""
    spark = source.sparkSession
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().orderBy("file_path").collect()  # a row a file
    app = spark.sparkContext.applicationId
    digest = hashlib.sha256(repr((name, [tuple(f) for f in files])).encode()).hexdigest()[:20]
    folder = f"{shared_dir(spark)}/tessera-stored/{app}/{name}-{digest}"
    if folder not in FOUND:
        build(folder)
        FOUND[folder] = None
    return folder
