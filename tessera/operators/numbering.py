"""Numbering rows within keys without one task a key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import stored


def numbered(df: DataFrame, keys: list[str], order: list, keep: list[str], name: str = "n") -> DataFrame:
    """``keys``, ``keep`` and ``name``: the number of each row within its keys, from 1, in ``order``.

    Rows are dealt by ranges of (keys, order), so a key of any size is cut over tasks.  Each task numbers what it has; one row a
    task then says how many rows of its first key lie before it.  Equal rows are interchangeable; nulls are a key of their own.
    """
    tied = df.withColumns({"__tie": F.monotonically_increasing_id(), "__key": F.xxhash64(*keys)})
    ranged = tied.repartitionByRange(*keys, *order, "__tie").sortWithinPartitions(*keys, *order, "__tie")
    lean = ranged.select(*keys, *keep, "__key", F.spark_partition_id().alias("__part"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields]

    def count(batches):
        last, upto, row = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.num_columns - 2).to_numpy()
            at = np.arange(len(k))
            new = np.append(last is None or k[0] != last, k[1:] != k[:-1])
            start = np.maximum.accumulate(np.where(new, at, -1))
            n = np.where(start < 0, upto + at + 1, at - start + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int64)), pa.array(at.astype(np.int64) + row)], [*b.schema.names, name, "__row"])
            last, upto, row = k[-1], int(n[-1]), row + len(k)

    rows = stored(lean.mapInArrow(count, ", ".join([*fields, f"`{name}` long", "__row long"])), "numbered")
    ends = rows.groupBy("__part").agg(F.min_by("__key", "__row").alias("first"), F.max_by("__key", "__row").alias("last"), F.max_by(name, "__row").alias("held"))
    before = F.sum("held").over(Window.partitionBy("last").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    total = ends.groupBy(F.col("last").alias("key")).agg(F.sum("held").alias("total"))
    offset = F.when(F.col("first") == F.col("last"), F.col("before")).otherwise(F.col("total"))
    ends = ends.withColumn("before", before).join(total, F.col("first") == F.col("key"), "left")
    ends = ends.select("__part", F.col("first").alias("__first"), F.coalesce(offset, F.lit(0)).alias("__offset")).where("__offset > 0")
    # one row a task: its size is the number of partitions
    joined = rows.join(F.broadcast(ends), "__part", "left")
    return joined.select(*keys, *keep, (F.col(name) + F.when(F.col("__key") == F.col("__first"), F.col("__offset")).otherwise(0)).alias(name))
