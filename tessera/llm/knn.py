"""Operator 8: exact top-k inner products by a Voronoi kNN join.

Components become ``floor(256 * x)``.  With M the largest norm, a vector x gets the extra coordinate sqrt(M^2 - |x|^2) and a query 0; then
distance^2 = |q|^2 + M^2 - 2 q.x, so near and large product are one order for each query.  Queries and data are grouped by nearest pivot;
the number of pivots grows with the root of the data, up to ``MAX_PIVOTS``.  Groups are cut by distance to their pivot into blocks of bounded size.

A group's summary is its size, its farthest distance and the distance within which its first k + 1 vectors lie; at most ``MAX_PIVOTS`` summaries go to the tasks.
From them a query block gets an upper bound of its k-th distance (k + 1 vectors lie within: one may be the query itself), and from that the groups, and within a group the span of distances to the pivot, that can hold a neighbour.
An equi-join on the group with that span gives the pairs of query block and data block; queries are copied to the data blocks that need them, bundled up to ``QUERY_BLOCK``, and data never
moves twice.  A vector that a third of the rows share fills one span of one group; its rows are dealt over blocks of bounded size.  Products are exact integers.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of no components have product 0; vectors of different lengths are never compared; ties go to the smaller
vec_id, null ids last; rows with one vec_id are different rows, and only the query's own row is left out; a query without
candidates has no rows; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import small_batches, work_table

K, EVERY, SCALE = 5, 50, 256.0
MIN_PIVOTS, MAX_PIVOTS, SAMPLE_VALUES = 16, 1024, 1 << 22
SLICES = 512
QUERY_BLOCK, DATA_BLOCK = 512, 2048
SLACK = 1e-6


def usable(vectors: DataFrame, flag: str, column: str = "embedding") -> DataFrame:
    """(uid, vec_id, q, v array<double>) of the rows that take part; v holds whole numbers."""
    x = F.col(column)
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(fine).select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col(flag).alias("q"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double")).alias("v"))


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in column])


def lifted(m: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(top - (m * m).sum(1), 0.0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products as int64: in floating point where every partial sum is below 2**53."""
    most = float(np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row: score down, then id up."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def knn_join(vectors: DataFrame, is_query: F.Column, k: int = K, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest product for each row that ``is_query`` marks."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = work_table(usable(vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))), "__q"), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    lengths = [r[0] for r in rows.groupBy(F.size("v").alias("n")).agg(F.max("q").alias("q")).where("q").select("n").collect()]
    out = None
    for n in sorted(lengths):
        of = rows.where(F.size("v") == n)
        part = _join(of if n else of.withColumn("v", F.array(F.lit(0.0))), max(n, 1), k, pivots)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def pivots_for(n: int) -> int:
    return min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(n) // 4))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a bounded sample."""
    chosen = [0]
    d = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def placed(rows: DataFrame, dims: int, pivots: int | None) -> tuple[DataFrame, np.ndarray, float]:
    """Rows of data and of queries with group and distance to the pivot; the pivots; the largest distance that can be."""
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()
    pivots = pivots or pivots_for(n)
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(max(1, min(8 * pivots, SAMPLE_VALUES // dims))).select("v").collect()
    centre = _spread(lifted(matrix([r[0] for r in sample]).reshape(len(sample), dims), top), pivots)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                m = matrix(pdf["v"]).reshape(len(pdf), dims)
                for query in (False, True):
                    on = pdf["q"].to_numpy(bool) if query else np.ones(len(pdf), bool)
                    if on.any():
                        x = np.hstack([m[on], np.zeros((on.sum(), 1))]) if query else lifted(m[on], top)
                        d = distances(x, centre)
                        g = d.argmin(1)
                        yield pdf.loc[on, ["uid", "vec_id", "v"]].assign(query=query, grp=g.astype("int32"), dist=d[np.arange(len(g)), g])

    out = rows.mapInPandas(place, "grp int, dist double, uid long, vec_id long, v array<double>, query boolean")
    return work_table(out, "placed"), centre, max(2 * top, 1.0) ** 0.5


def cut_in_blocks(rows: DataFrame, width: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (query, grp, b, near, far, n, rows) and data groups (grp, n, far, first).  Windows run over counts of slices, at most ``SLICES`` and one a group."""
    fine = rows.withColumn("slice", F.floor(F.col("dist") / F.lit(width / SLICES)).cast("long"))
    counts = work_table(fine.groupBy("query", "grp", "slice").agg(F.count("*").alias("n"), F.max("dist").alias("far")), "slices")
    w = Window.partitionBy("query", "grp").orderBy("slice")
    base = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = base.where("not query").withColumn("within", F.when(F.col("before") + F.col("n") >= k + 1, F.col("far")))
    groups = upto.groupBy("grp").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.min("within").alias("first"))
    size = F.when(F.col("query"), QUERY_BLOCK).otherwise(DATA_BLOCK)
    salt = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / size))
    blocked = fine.join(F.broadcast(base.drop("far")), ["query", "grp", "slice"]).withColumn("blk", F.floor(F.col("before") / size)).withColumn("salt", F.when(F.col("n") > size, F.col("slice") * 1_000_000 + salt + 1).otherwise(F.lit(0)))
    per = blocked.groupBy("query", "grp", "blk", "salt").agg(F.min("dist").alias("near"), F.max("dist").alias("far"), F.count("*").alias("n"), F.collect_list(F.struct("uid", "vec_id", "v")).alias("rows"))
    return work_table(per.withColumn("b", F.monotonically_increasing_id()), "blocks"), groups


class Bounds:
    """Group summaries, and what a query block needs of each group."""

    def __init__(self, centre: np.ndarray, groups: pd.DataFrame, k: int):
        self.centre, self.k = centre, k
        self.grp, self.n = groups["grp"].to_numpy(int), groups["n"].to_numpy(int)
        self.far, self.first = groups["far"].to_numpy(float), groups["first"].to_numpy(float)

    def spans(self, grp: int, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(groups, lowest, highest distance to their pivots) for queries within ``far`` of pivot ``grp``."""
        gap = distances(self.centre[grp : grp + 1], self.centre[self.grp])[0]
        upper = far + gap + self.far
        at = np.argsort(upper, kind="stable")
        reach = np.searchsorted(np.cumsum(self.n[at]), self.k + 1)
        bound = upper[at[reach]] if reach < len(at) else np.inf
        bound = min(bound, np.nanmin(np.append(far + gap + self.first, np.inf)))
        bound = bound * (1 + SLACK) + SLACK
        # a vector of another cell is at least half as far as the difference of the two pivots' distances
        fits = (gap - far - self.far <= bound) & ((gap - 2 * far) / 2 <= bound)
        return self.grp[fits], (gap - far - bound)[fits], (gap + far + bound)[fits]


def needed(blocks: DataFrame, bounds: Bounds) -> DataFrame:
    """(qb, b): the pairs of blocks that the bounds leave."""
    shared = blocks.sparkSession.sparkContext.broadcast(bounds)

    def spans(batches):
        for pdf in batches:
            for qb, grp, far in zip(pdf["b"], pdf["grp"], pdf["far"]):
                g, low, high = shared.value.spans(int(grp), float(far))
                yield pd.DataFrame({"qb": np.full(len(g), qb), "grp": g.astype("int32"), "low": low, "high": high})

    wanted = blocks.where("query").select("b", "grp", "far").mapInPandas(spans, "qb long, grp int, low double, high double")
    data = blocks.where("not query").select("grp", "b", "near", F.col("far").alias("to"))
    return wanted.join(data, "grp").where("near <= high and to >= low").select("qb", "b")


def _list(column: pa.ListArray, i: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uid, vec_id (the largest number for null), whether it is null, and the vectors of row i."""
    part = column[i].values
    ids = part.field("vec_id")
    return part.field("uid").to_numpy(), ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.field("v").flatten().to_numpy().reshape(len(part), dims)


def _join(rows: DataFrame, dims: int, k: int, pivots: int | None) -> DataFrame:
    there, centre, width = placed(rows, dims, pivots)
    blocks, groups = cut_in_blocks(there, width, k)
    pairs = needed(blocks, Bounds(centre, groups.toPandas(), k))
    data = blocks.where("not query").select("b", F.col("rows").alias("d"))
    # small query blocks that one data block needs go together
    asked = blocks.where("query").select(F.col("b").alias("qb"), F.col("n").alias("qn"), F.col("rows").alias("qs"))
    # every deal of blocks to bundles is right; this one fills them about evenly
    bundle = F.pmod(F.xxhash64("qb"), F.lit(max(1, -(-(asked.agg(F.sum("qn")).first()[0] or 0) // QUERY_BLOCK))))
    bundled = pairs.join(asked, "qb").withColumn("bundle", F.when(F.col("qn") >= QUERY_BLOCK // 2, -F.col("qb") - 1).otherwise(bundle))
    bundled = bundled.groupBy("b", "bundle").agg(F.flatten(F.collect_list("qs")).alias("qs"))

    def solve(batches):
        names = ["quid", "query_id", "vec_id", "score", "uid"]
        for batch in batches:
            for r in range(batch.num_rows):
                quid, qid, qnull, q = _list(batch.column(0), r, dims)
                uid, ids, null, x = _list(batch.column(1), r, dims)
                s, at, who = products(q, x), [], []
                for i in range(len(q)):
                    on = np.flatnonzero(uid != quid[i])
                    hit = on[best(s[i][on], ids[on], k)]
                    at.append(hit)
                    who.append(np.full(len(hit), i))
                if at:
                    at, who = np.concatenate(at), np.concatenate(who)
                    yield pa.RecordBatch.from_arrays([pa.array(quid[who]), pa.array(qid[who], mask=qnull[who]), pa.array(ids[at], mask=null[at]), pa.array(s[who, at]), pa.array(uid[at])], names)

    found = bundled.join(data, "b").select("qs", "d").mapInArrow(solve, "quid long, query_id long, vec_id long, score long, uid long")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
