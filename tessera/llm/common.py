"""Shared pieces: written work tables, row keys, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-work/{spark.sparkContext.applicationId}"


#: Rows and bytes of an Arrow batch where whole texts go to Python: a worker holds few of them at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES``; smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def clear_work_tables(spark: SparkSession) -> None:
    """Delete this application's work tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(text: str = "text") -> F.Column:
    """With the id, this tells rows apart whose ids clash."""
    return F.when(F.col(text).isNull(), F.xxhash64(F.lit(0), F.lit(0))).otherwise(F.xxhash64(F.col(text)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, *names: str):
    """Null-safe equality of the named columns."""
    out = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        out = c if out is None else out & c
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) for each node that has an edge.

    Alternates large-star and small-star steps; every step groups by node after a
    distinct, so a hub's links shrink to one per neighbour.  Each step is written to the shared folder.
    The root is the smallest node of the component.  An empty table gives an empty table.
    """
    e = work_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = work_table(small, "stars")
        was, now = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for x in (e, nxt))
        e = nxt
        if was == now:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
