"""Results kept for a time: a cache of written tables with an age limit and a limit on their number."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_dir


class ResultCache:
    """Results by key, written to the shared folder when first asked for.

    One that is older than ``ttl`` seconds is made anew; of more than ``most``, the one used longest ago goes.  A result that has gone can still be read by those who hold it until ``grace`` more
    results have gone, so a running job keeps its files.
    """

    def __init__(self, spark: SparkSession, ttl: float, most: int, grace: int = 2, clock: Callable[[], float] = time.monotonic):
        self.spark, self.ttl, self.most, self.grace, self.clock = spark, ttl, most, grace, clock
        self.held: OrderedDict[tuple, tuple[str, object, float]] = OrderedDict()
        self.gone: list[str] = []
        self.hits = self.misses = self.expired = self.evicted = 0

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.held.pop(key, None)
        if found and self.clock() - found[2] > self.ttl:
            self.expired += 1
            self._drop(found[0])
            found = None
        if found:
            self.hits += 1
        else:
            self.misses += 1
            df, path = make(), f"{shared_dir(self.spark)}/tessera-stored/{self.spark.sparkContext.applicationId}/result-{uuid.uuid4().hex}"
            df.write.parquet(path)
            found = (path, df.schema, self.clock())
        self.held[key] = found
        while len(self.held) > self.most:
            self.evicted += 1
            self._drop(self.held.popitem(last=False)[1][0])
        return self.spark.read.schema(found[1]).parquet(found[0])

    def _drop(self, path: str) -> None:
        self.gone.append(path)
        while len(self.gone) > self.grace:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.gone.pop(0))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
