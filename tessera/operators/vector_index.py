"""An inverted-file index of vectors: every row in the list of its nearest centroid, lists probed by their centroids.

Centroids are fitted by k-means on a sample of at most ``SAMPLE`` rows, a parameter; every row is then placed.  Lists are folders, so a search reads the lists that it probes.  Candidates are
scored exactly.  ``search`` probes a fixed number of lists a query, and ``probes_for`` measures how many reach a recall.  ``exact`` adds every list that can still hold a better row: on the
unit sphere a row of a list is at least as far as its centroid less the list's radius.

Defined cases: vectors that are null, empty, of no length or not finite are not indexed and match nothing; ties go to the smaller key; an empty table cannot be indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V
from tessera.sources.shared import stored

SAMPLE, MOST_LISTS, LIST_ROWS = 50_000, 4096, 1 << 20
SLACK = 1e-6
#: Rows of a list, and queries, that meet in one product.
SLICE, QUERIES = 20_000, 256


def usable(points: DataFrame, vector: str) -> DataFrame:
    n = V.norm(vector)
    return points.where(F.col(vector).isNotNull() & (n > 0) & (n < float("inf")))


def build(points: DataFrame, folder: str, key: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 11) -> None:
    """Write ``folder/rows`` by list and ``folder/lists`` (list, centre, rows, radius)."""
    fine = usable(points, vector)
    n = fine.count()
    lists = lists or min(MOST_LISTS, max(2, math.isqrt(n)))
    features = fine.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))
    taken = features.orderBy(F.xxhash64(key), key).limit(sample).select("__f")
    model = KMeans(k=lists, seed=seed, maxIter=12, featuresCol="__f", predictionCol="list", distanceMeasure="cosine").fit(taken)
    spark = points.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")  # at most MOST_LISTS rows
    placed = model.transform(features).drop("__f").join(F.broadcast(centres), "list")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(vector, "centre"))))
    placed = placed.withColumn("angle", angle).drop("centre")
    # a list of over LIST_ROWS rows is cut over tasks
    placed.repartition("list", F.pmod(F.xxhash64(key), F.lit(max(1, n // LIST_ROWS)))).write.partitionBy("list").parquet(f"{folder}/rows")
    per = spark.read.parquet(f"{folder}/rows").groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    per.join(centres, "list").coalesce(1).write.parquet(f"{folder}/lists")


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, key: str, vector: str = "embedding"):
        self.rows, self.lists = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/lists")
        self.key, self.vector = key, vector

    def near_lists(self, queries: DataFrame) -> DataFrame:
        """(qid, q, list, rows, theta, radius, place): all lists of each query, nearest first."""
        near = usable(queries, "q").crossJoin(F.broadcast(self.lists))
        theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine("q", "centre"))))
        near = near.withColumn("theta", theta).drop("centre")
        return near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("theta", "list")))

    def scored(self, probes: DataFrame, k: int, best: DataFrame | None = None) -> DataFrame:
        """(qid, key, score, rank): the k best of the probed lists, and of ``best``.

        A list, or a slice of a large one, meets the queries that probe it in one product of matrices, and each query leaves it with its k best; with a column ``least`` in ``probes``,
        only with those that reach it.
        """
        key, vector = self.key, self.vector
        if "least" not in probes.columns:
            probes = probes.withColumn("least", F.lit(None).cast("double"))
        cut = F.broadcast(self.lists.select("list", F.ceil(F.col("rows") / SLICE).cast("int").alias("slices")))
        rows = self.rows.join(cut, "list").select("list", F.pmod(F.xxhash64(key), F.col("slices")).cast("int").alias("slice"), key, vector)
        asked = probes.select("list", "qid", "q", "least").join(cut, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "qid", "q", "least")
        kinds = {**dict(self.rows.dtypes), "qid": dict(probes.dtypes)["qid"]}

        def unit(vectors: pa.ChunkedArray) -> np.ndarray:
            v = vectors.combine_chunks()
            m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)
            return m / np.sqrt((m * m).sum(axis=1))[:, None]

        def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
            found = []
            if held.num_rows and asked.num_rows:
                m, keys = unit(held.column(vector)), held.column(key).to_numpy()
                least = np.nan_to_num(asked.column("least").to_numpy().astype(np.float64), nan=-np.inf)
                qs, qids = unit(asked.column("q")), asked.column("qid").to_numpy()
                for i in range(0, len(qs), QUERIES):
                    score = np.round(qs[i : i + QUERIES] @ m.T, 6)
                    floor = least[i : i + QUERIES]
                    if len(keys) > k:
                        floor = np.maximum(floor, np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k])
                    at, row = np.nonzero(score >= floor[:, None])
                    order = np.lexsort((keys[row], -score[at, row], at))
                    at, row = at[order], row[order]
                    first = np.searchsorted(at, at, "left")
                    on = np.arange(len(at)) - first < k
                    at, row = at[on], row[on]
                    found.append(pa.table([qids[i + at], keys[row], score[at, row]], ["qid", key, "score"]))
            return pa.concat_tables(found) if found else pa.table([pa.array(qids_of(asked)), pa.array(keys_of(held)), pa.array([], pa.float64())], ["qid", key, "score"])

        qids_of, keys_of = (lambda t: t.column("qid").slice(0, 0).combine_chunks()), (lambda t: t.column(key).slice(0, 0).combine_chunks())
        met = rows.groupBy("list", "slice").cogroup(asked.groupBy("list", "slice")).applyInArrow(meet, f"qid {kinds['qid']}, `{key}` {kinds[key]}, score double")
        if best is not None:
            met = met.unionByName(best.select("qid", self.key, "score"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), self.key)
        return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The k best of ``queries(qid, q)`` within each query's ``probes`` nearest lists."""
        return self.scored(self.near_lists(queries).where(F.col("place") <= probes), k)

    def exact(self, queries: DataFrame, k: int, probes: int = 2) -> DataFrame:
        """As a scan of all rows: after ``probes`` lists, only those that can hold a row above the k-th score."""
        near = self.near_lists(queries)
        early = stored(self.scored(near.where(F.col("place") <= probes), k), "early")
        least = early.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        reach = F.cos(F.greatest(F.col("theta") - F.col("radius"), F.lit(0.0)))
        rest = near.where(F.col("place") > probes).join(least, "qid", "left").where(F.col("least").isNull() | (reach >= F.col("least") - SLACK))
        return self.scored(rest, k, early)

    def probes_for(self, queries: DataFrame, truth: DataFrame, recall: float) -> int:
        """The fewest lists a query that hold ``recall`` of ``truth(qid, key)``, the true neighbours of some queries."""
        where = self.rows.select(self.key, "list").join(truth.select("qid", self.key), self.key)
        place = where.join(self.near_lists(queries).select("qid", "list", "place"), ["qid", "list"])
        return int(place.agg(F.percentile("place", F.lit(recall))).first()[0] + 0.999999)
