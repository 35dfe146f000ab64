"""Operator 6: mix sources to target weights by Pareto order sampling.

A source's target in words is its share by weight of ``total_share`` of all words, at most ``cap`` times its own size; what the cap
cuts off goes to the others by weight until none is above.  A document expects ``target / source size`` copies: the whole part is
certain, the rest is its inclusion probability p.  Documents are ranked by the random odds u/(1-u) divided by the inclusion odds
p/(1-p); with u from a hash of the row, reruns agree.  The sample is the shortest start of that order whose words come nearest to the
words still owed.  An optional ``propensity`` column makes p unequal within a source (p in proportion, cut at 1).

No task gathers a source: sizes are summed by (source, slice of the order), the slice in which the sample ends is found among at most
``SLICES`` sums, and only its rows are ordered one by one.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are taken 0 words; a very long text is counted whole and is an item like any other; other columns, whatever their names, are ignored; ties in the order go by id and text, and equal rows
share one u and are told apart by nothing, so they are taken or left together; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import row_key, work_table

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE, CAP, SLICES, SEED = 1.5, 2.0, 4096, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight, none above ``cap`` times its size."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


def mix_sources(docs: DataFrame, carry: list[str] | None = None, weights=WEIGHTS, total_share: float = TOTAL_SHARE, cap: float = CAP, propensity: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, key, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    u = F.conv(F.substring(F.sha2(F.concat_ws("\x01", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 12), 16, 10).cast("double")
    rows = docs.select(
        "doc_id", "source", row_key().alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((u + 0.5) / float(1 << 48)).alias("u"), (F.col(propensity) if propensity else F.lit(1.0)).cast("double").alias("w"))
    rows = work_table(rows, "mix")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("drawn"))
    got = sorted(per.collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [float(r[1]) for r in got]
    if not got:
        return rows.select("doc_id", "source", "key", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"))
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(got))], total_share * sum(sizes), cap)
    plan = spark.createDataFrame([(r[0], int(s), t, (t / float(r[2]) if r[2] else 0.0)) for r, s, t in zip(got, sizes, target)], "source string, source_size long, target double, rate double")
    if len(got) <= 100_000:
        plan = F.broadcast(plan)
    plan = plan.withColumnRenamed("source", "__s")
    r = rows.join(plan, rows["source"].eqNullSafe(plan["__s"])).drop("__s")
    e = F.least(F.col("rate") * F.col("w"), F.lit(float(cap)))
    r = r.withColumn("whole", F.floor(e + 1e-9)).withColumn("p", F.greatest(e - F.col("whole"), F.lit(0.0)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    r = r.withColumn("q", F.when(F.col("p") > 1e-12, odds))
    r = r.withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES))
    sums = r.groupBy("source", "slice").agg(F.sum(F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    by = Window.partitionBy("source")
    sums = sums.withColumn("owed", F.col("target") - F.sum("sure").over(by))
    run = by.orderBy(F.col("slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    edge = sums.where("slice is not null and before < owed and upto >= owed").groupBy("source").agg(F.min_by(F.struct("slice", "before", "owed"), "slice").alias("e"))
    edge = edge.select(F.col("source").alias("__s"), "e.*").withColumnsRenamed({"slice": "cut"})
    tight = sums.groupBy("source").agg(F.max("upto").alias("all"), F.first("owed").alias("owed")).where("all < owed").select(F.col("source").alias("__t"))
    if len(got) <= 100_000:
        edge, tight = F.broadcast(edge), F.broadcast(tight)
    r = r.join(edge, r["source"].eqNullSafe(edge["__s"]), "left").join(tight, F.col("source").eqNullSafe(F.col("__t")), "left")
    inside = r.where("q is not null and slice = cut")
    order = Window.partitionBy("source").orderBy("q", "doc_id", "key").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    inside = inside.withColumn("extra", F.abs(F.col("upto") - F.col("owed")) <= F.abs(F.col("upto") - F.col("size") - F.col("owed"))).drop("upto")
    rest = r.where("q is null or cut is null or slice <> cut").withColumn("extra", F.expr("q is not null and (slice < cut or (cut is null and `__t` is not null))"))
    copies = (F.col("whole") + F.col("extra").cast("int")).cast("long")
    return inside.unionByName(rest).select("doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
