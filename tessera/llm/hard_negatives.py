"""Operator 13: hard negatives by early discards in rotated coordinates.

Components become ``floor(256 * x)``.  The second moments of all rows give an orthogonal rotation that puts most of the energy in the leading
components.  For a tile of anchors and rows the products of the leading 8, 16 and then 32 rotated components are summed; by Cauchy-Schwarz the rest is
at most the product of the norms of what is left, and slack covers the rounding of rotation and sums.  A pair whose upper bound lies below what it must reach, or whose
lower bound lies above what it may reach, goes at once; the rest is settled by integer products.  The rotation decides work, never results.

Positives come first, from tiles of one label; what a pair must reach is then the fifth best lower bound of its anchor.  Negatives come from tiles of all rows: what a
pair must reach for some positive is four fifths of its score, or the fifth best lower bound of rows that surely fit under it.  A tile is about ``VALUES`` numbers of rows and a sixteenth of
that of anchors, whatever their labels: anchors are copied to each block of rows, rows are not moved again.  Each tile returns at most five rows a positive.

Defined cases: rows with a null label or vector, or a null or non-finite component take no part; a null vec_id is never an anchor, its label is not shifted and it comes last among ties; vectors of no components have product 0; vectors of
different lengths are never compared; rows with one vec_id are different rows; an anchor without positives, or a positive without negatives, has no rows; integer products are those of 64 bits;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import small_batches, work_table
from tessera.llm.knn import products

K, EVERY, SHIFT_EVERY, LABELS, SCALE = 5, 100, 7, 10, 256.0
STAGES = (8, 16, 32)
VALUES = 1 << 18
MAX_ROTATED, MAX_ROTATIONS = 256, 8
MAX_BROADCAST = 100_000
ROUNDING = 1e-11


def usable(vectors: DataFrame, every: int = EVERY, shift_every: int = SHIFT_EVERY) -> DataFrame:
    """(uid, vec_id, label, dims, anchor, v) of the rows that take part, with the shifted labels."""
    x = F.col("embedding")
    fine = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    label = F.col("label").cast("long")
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double"))
    return vectors.where(fine).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", F.when(F.col("vec_id") % shift_every == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.size(x).alias("dims"), F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("anchor"), F.when(F.size(x) == 0, F.array(F.lit(0.0))).otherwise(whole).alias("v"))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each of the commonest lengths up to ``MAX_ROTATED``: eigenvectors of the second moments of all its rows, largest first."""
    common = [r[0] for r in rows.groupBy("dims").count().where(F.col("dims").between(2, MAX_ROTATED)).orderBy(F.desc("count"), "dims").limit(MAX_ROTATIONS).collect()]
    if not common:
        return {}

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                m = b.column(1).filter(pa.array(dims == d)).flatten().to_numpy().reshape(-1, d)
                sums[d] = sums.get(d, 0) + m.T @ m
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(m))], ["dims", "i", "row"])

    parts = rows.where(F.col("dims").isin(common)).select("dims", "v").mapInArrow(moments, "dims int, i int, row array<double>")
    cells = parts.select("dims", "i", F.posexplode("row").alias("j", "x")).groupBy("dims", "i", "j").agg(F.sum("x").alias("x"))
    found = {d: np.zeros((d, d)) for d in common}
    for r in cells.groupBy("dims", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("row")).collect():  # at most MAX_ROTATIONS * MAX_ROTATED rows
        found[r["dims"]][r["i"]] = r["row"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in found.items() if np.isfinite(m).all()}


def dealt(rows: DataFrame, keys: list[str], columns: list[str], values: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (keys, slot, name) of at most about ``values`` numbers, and (keys, slots)."""
    sizes = work_table(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("slots", F.ceil(F.col("n") * F.greatest("dims", F.lit(1)) / values)).drop("n"), "tile-sizes")
    few = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes
    slot = F.pmod(F.xxhash64("uid"), F.col("slots"))
    blocks = rows.join(few, keys).withColumn("slot", slot).groupBy(*keys, "slot").agg(F.collect_list(F.struct(*columns)).alias(name))
    return blocks, sizes


def tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], more: list[str] = []) -> DataFrame:
    """(a, d): each block of anchors beside each block of rows with equal keys."""
    data, slots = dealt(rows, keys, ["uid", "vec_id", "label", "v"], VALUES, "d")
    asked, _ = dealt(anchors, keys, ["uid", "vec_id", "label", "v", *more], VALUES // 16, "a")
    copies = asked.drop("slot").join(slots, keys).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")
    return copies.join(data, [*keys, "slot"]).select("a", "d")


class Side:
    """One side of a tile: ids, labels, whole vectors, rotated vectors and the norms of what is left after each stage."""

    def __init__(self, part: pa.StructArray, rotation: dict[int, np.ndarray]):
        ids = part.field("vec_id")
        self.uid, self.ids, self.null = part.field("uid").to_numpy(), ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.label = part.field("label").to_numpy()
        self.v = part.field("v").flatten().to_numpy().reshape(len(part), -1)
        d = self.v.shape[1]
        self.r = self.v @ rotation[d] if d in rotation else self.v
        self.norm = np.sqrt((self.v * self.v).sum(1))
        self.left = {p: np.sqrt((self.r[:, p:] ** 2).sum(1)) for p in STAGES if p < d}


def kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf if there are fewer columns."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def survivors(q: Side, x: Side, open_: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and integer products of the pairs of ``open_`` that ``fits(low, high, open_)`` leaves at every stage."""
    sums, at = np.zeros(open_.shape), 0
    slack = ROUNDING * q.v.shape[1] * np.outer(q.norm, x.norm)
    for p, left in q.left.items():
        on = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(on[0]):
            break
        grid = np.ix_(*on)
        sums[grid] += q.r[on[0], at:p] @ x.r[on[1], at:p].T
        rest = np.outer(left, x.left[p]) + slack
        open_ = open_ & fits(np.where(open_, sums - rest, -np.inf), np.where(open_, sums + rest, -np.inf))
        at = p
    i, j = np.nonzero(open_)
    if 4 * len(i) > open_.size:
        return i, j, products(q.v, x.v)[i, j]
    score = np.empty(len(i), np.int64)
    a, b = q.v.astype(np.int64), x.v.astype(np.int64)
    for s in range(0, len(i), 16384):
        score[s : s + 16384] = (a[i[s : s + 16384]] * b[j[s : s + 16384]]).sum(1)
    return i, j, score


def in_order(x: Side, i: np.ndarray, j: np.ndarray, score: np.ndarray):
    """Pairs by anchor, then score down, then id up."""
    at = np.lexsort((x.uid[j], x.ids[j], x.null[j], -score, i))
    return i[at], j[at], score[at]


def first(i: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first k of each run of equal numbers."""
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    return np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k


def positives(rows: DataFrame, rotation, k: int = K) -> DataFrame:
    """(auid, uid, vec_id, score): the k best other rows of an anchor's label."""
    shared = rows.sparkSession.sparkContext.broadcast(rotation)

    def solve(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, x = Side(b.column(0)[r].values, shared.value), Side(b.column(1)[r].values, shared.value)
                other = (q.uid[:, None] != x.uid) & (q.label[:, None] == x.label)
                i, j, s = in_order(x, *survivors(q, x, other, lambda low, high: high >= kth(low, k)[:, None]))
                on = first(i, k)
                i, j = i[on], j[on]
                yield pa.RecordBatch.from_arrays([pa.array(q.uid[i]), pa.array(x.uid[j]), pa.array(x.ids[j], mask=x.null[j]), pa.array(s[on])], ["auid", "uid", "vec_id", "score"])

    found = tiles(rows.where("anchor"), rows, ["dims", "label"]).mapInArrow(solve, "auid long, uid long, vec_id long, score long")
    order = Window.partitionBy("auid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def negatives(anchors: DataFrame, rows: DataFrame, rotation, k: int = K) -> DataFrame:
    """Of ``anchors(.., p array of positives)`` and ``rows``: the k best rows of other labels between four fifths of a positive's score and that score."""
    shared = rows.sparkSession.sparkContext.broadcast(rotation)
    names = ["auid", "anchor_id", "puid", "positive_id", "positive_score", "uid", "negative_id", "negative_score"]

    def solve(batches):
        for b in batches:
            for r in range(b.num_rows):
                part = b.column(0)[r].values
                q, x = Side(part, shared.value), Side(b.column(1)[r].values, shared.value)
                pos = part.field("p")
                held, every = np.diff(pos.offsets.to_numpy()), pos.flatten()
                row, col = np.repeat(np.arange(len(q.uid)), held), np.concatenate([np.arange(n) for n in held] or [np.zeros(0, int)])
                score, at = np.full((len(q.uid), k), -1, np.int64), np.zeros((len(q.uid), k), np.int64)
                score[row, col], at[row, col] = every.field("score").to_numpy(), np.arange(len(row))

                def fits(low, high):
                    keep = np.zeros(low.shape, bool)
                    for n in range(k):
                        top = score[:, n : n + 1]
                        sure = np.where(high <= top, low, -np.inf)
                        keep |= (top >= 0) & (low <= top) & (high >= np.maximum(0.8 * top - 1e-6 * np.abs(top) - 1e-6, kth(sure, k)[:, None]))
                    return keep

                i, j, s = in_order(x, *survivors(q, x, q.label[:, None] != x.label, fits))
                for n in range(k):
                    top = score[i, n]
                    on = np.flatnonzero((top >= 0) & (s <= top) & (5 * s >= 4 * top))
                    on = on[first(i[on], k)]
                    a, c, p = i[on], j[on], pa.array(at[i[on], n])
                    yield pa.RecordBatch.from_arrays([pa.array(q.uid[a]), pa.array(q.ids[a]), every.field("uid").take(p), every.field("vec_id").take(p), pa.array(score[a, n]), pa.array(x.uid[c]), pa.array(x.ids[c], mask=x.null[c]), pa.array(s[on])], names)

    found = tiles(anchors, rows, ["dims"], ["p"]).mapInArrow(solve, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("auid", "puid").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    small_batches(vectors.sparkSession)
    rows = work_table(usable(vectors, every), "vectors")
    rotation = rotations(rows)
    best = work_table(positives(rows, rotation, k), "positives")
    held = best.where("score >= 0").groupBy("auid").agg(F.sort_array(F.collect_list(F.struct("score", "uid", "vec_id")), asc=False).alias("p"))
    anchors = rows.where("anchor").join(held, F.col("uid") == F.col("auid")).drop("auid")
    return negatives(anchors, rows, rotation, k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.vec_id AS anchor_id, d.vec_id AS vec_id, q.label = d.label AS same, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
