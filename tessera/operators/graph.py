"""Graph queries over an edge table (rel, src, dst).

Traversals are hop-wise joins with a distinct per hop and an anti join against what was seen, so cycles end and a hop moves only its frontier.  Sizes of neighbourhoods of all nodes come from sketches.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered
from tessera.sources.shared import dropped, shuffles_end, stored


def steps(edges: DataFrame, rels: list[str] | None = None, direction: str = "out", ready: bool = False) -> DataFrame:
    """(src, dst), the steps that a traversal may take: edges of the listed types (all, if none are), along, against or either way; stored, each once.

    ``ready`` edges are stored and distinct already, so along or against them nothing is written again.
    """
    e = edges if rels is None else edges.where(F.col("rel").isin(*rels))
    out, back = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if ready and rels is None and direction != "both":
        return out if direction == "out" else back
    return stored({"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct(), "steps")


def reach(edges: DataFrame, start: DataFrame, hops: int, rels: list[str] | None = None, direction: str = "out", ready: bool = False) -> DataFrame:
    """(start, node, hop): nodes within ``hops`` steps, with the least number of steps; the start only if a cycle returns to it.

    Steps are stored once and each frontier when it is found, so a hop reads them and plans nothing again; it ends when a frontier is empty.
    """
    e = steps(edges, rels, direction, ready)
    front, seen = start.select(F.col("node").alias("start"), "node"), None
    for hop in range(1, hops + 1):
        step = front.join(e, front["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["start", "node"], "left_anti")
        step = stored(step.withColumn("hop", F.lit(hop)), "frontier")
        seen = step if seen is None else seen.unionByName(step)
        front = step.select("start", "node")
        if hop < hops and step.isEmpty():
            break
    return seen


#: Starts of one word of bits, and words of a row of ``reach_counts``.
WORD, WORDS = 63, 8


def reach_counts(edges: DataFrame, start: DataFrame, hops: int, rels: list[str] | None = None, direction: str = "out", ready: bool = False) -> DataFrame:
    """(start, direct, transitive): for each start that takes a step, the nodes one step away and those within ``hops`` steps; the counts of ``reach`` without its pairs.

    Starts are numbered in their order, and ``WORD * WORDS`` of them share rows: a row is a node with the starts that reach it as bits.  A hop joins rows to steps and
    merges them by node, so it moves a row a node and set of starts where ``reach`` moves one a node and start.
    """
    e = steps(edges, rels, direction, ready)
    size, words = WORD * WORDS, [f"w{i}" for i in range(WORDS)]
    n = numbered(start.select("node").distinct().withColumn("all", F.lit(0)), ["all"], ["node"], ["node"])
    n = stored(n.select("node", F.floor((F.col("n") - 1) / size).alias("set"), ((F.col("n") - 1) % size).cast("int").alias("bit")), "starts")
    bit = lambda i: F.when(F.floor(F.col("bit") / WORD) == i, F.expr(f"shiftleft(1L, bit % {WORD})")).otherwise(F.lit(0).cast("long"))
    merge = lambda d: d.groupBy("node", "set").agg(*[F.bit_or(w).alias(w) for w in words])
    front, found = n.select("node", "set", *[bit(i).alias(w) for i, w in enumerate(words)]), []
    for hop in range(1, hops + 1):
        with shuffles_end(edges.sparkSession):
            front = stored(merge(front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), "set", *words)), "frontier")
        found.append(front)
        if hop < hops and front.isEmpty():
            break

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        word = rows.select("set", F.posexplode(F.array(*words)).alias("word", "w")).where("w <> 0")
        ones = word.groupBy("set", "word").agg(*[F.sum(F.shiftright("w", b).bitwiseAND(1)).alias(str(b)) for b in range(WORD)])
        one = ones.select("set", "word", F.posexplode(F.array(*[F.col(f"`{b}`") for b in range(WORD)])).alias("b", name))
        return one.select("set", (F.col("word") * WORD + F.col("b")).alias("bit"), name)

    near, far = sizes(found[0], "direct"), sizes(merge(reduce(DataFrame.unionByName, found)), "transitive")
    return n.join(near, ["set", "bit"]).join(far, ["set", "bit"]).where("transitive > 0").select(F.col("node").alias("start"), "direct", "transitive")


#: Registers of a neighbourhood sketch, as a power of two, and the standard error of its count relative to the count.
SKETCH_LG = 9
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG / 2)
#: Most nodes of a block of ``reach_sizes``: each has a sketch in the memory of its task.
BLOCK_NODES = 200_000
HELD = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def packed(steps: DataFrame, width: int) -> DataFrame:
    """(block, dst, takers, own) of steps in order of ``dst``: the nodes of a block of ``width`` that step to ``dst``, as distances from its first, and whether it is the block of ``dst`` itself.

    Steps are packed where they lie, so nothing is shuffled; a list that a batch cuts is two rows.  Each ``dst`` has a row in its own block, with no takers if need be.
    """

    def run(batches):
        for b in batches:
            src, dst = b.column("src").to_numpy(), b.column("dst").to_numpy()
            if not len(src):
                continue
            ends = np.unique(dst)  # a mark in the own block of each
            block = np.concatenate([src // width, ends // width])
            to, at = np.concatenate([dst, ends]), np.concatenate([src % width, np.full(len(ends), -1)])
            order = np.lexsort((at, to, block))
            block, to, at = block[order], to[order], at[order]
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (to[1:] != to[:-1])])
            real = at >= 0
            offsets = np.r_[0, np.cumsum(real)][np.r_[first, len(at)]]
            takers = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at[real], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(block[first], pa.int64()), pa.array(to[first], pa.int64()), takers, pa.array(to[first] // width == block[first])], ["block", "dst", "takers", "own"])

    whole = steps.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return whole.mapInArrow(run, "block long, dst long, takers array<int>, own boolean")


def reach_sizes(edges: DataFrame, hops: int, rels: list[str] | None = None, direction: str = "out", ready: bool = False) -> DataFrame:
    """(node, reached): for every node with a step, about how many nodes lie within ``hops`` steps; the standard error is ``SKETCH_ERROR``.  Nodes are whole numbers.

    Each node holds a sketch of itself and the nodes it reaches; a round passes sketches back along the steps and merges them, in the last one without the node itself.  Nodes are cut into
    blocks of neighbouring numbers: a sketch goes once to each block that has a step to its node, with the packed list of those that take it, and is copied and merged only there.
    A round's sketches are deleted after the next one, its shuffle files when it ends.  ``ready`` edges are in order of their source.
    """
    spark = edges.sparkSession
    e = steps(edges, rels, direction, ready)
    low, high = e.agg(F.min("src"), F.max("src")).first()
    width = min(BLOCK_NODES, ((high or 0) - (low or 0)) // (2 * spark.sparkContext.defaultParallelism) + 1)
    ordered = e if ready and rels is None and direction == "in" else e.repartition("dst").sortWithinPartitions("dst")
    before, far = spark.conf.get(HELD), None
    spark.conf.set(HELD, 2 * BLOCK_NODES)  # sorting by node would write the copies of every sketch
    try:
        with shuffles_end(spark):
            takers = stored(packed(ordered, width), "takers")
            for hop in range(1, hops + 1):
                last = hop == hops
                sent = takers if far is None else takers.join(far, takers["dst"] == far["node"]).select("block", "takers", "own", "dst", "s")
                sent = (sent.where(F.size("takers") > 0) if last else sent).repartition("block")
                first = F.col("block") * width
                taken = F.col("takers") if last else F.when(F.col("own"), F.concat("takers", F.array((F.col("dst") - first).cast("int")))).otherwise(F.col("takers"))
                copies = sent.select("block", F.explode(taken).alias("at"), "dst" if far is None else "s")
                merged = F.hll_sketch_agg("dst", F.lit(SKETCH_LG)) if far is None else F.hll_union_agg("s")
                found = copies.groupBy("block", "at").agg(merged.alias("s")).select((first + F.col("at")).alias("node"), F.hll_sketch_estimate("s").alias("reached") if last else F.col("s"))
                old, far = far, stored(found, "sizes" if last else "sketches")
                if old is not None:
                    dropped(old)
            dropped(takers)
    finally:
        spark.conf.set(HELD, before)
    return far


def neighbours(edges: DataFrame, node, direction: str) -> DataFrame:
    """(direction, node) one step from ``node``: imports, imported_by or both."""
    out = edges.where(F.col("src") == node).select(F.lit("imports").alias("direction"), F.col("dst").alias("node")).distinct()
    back = edges.where(F.col("dst") == node).select(F.lit("imported_by").alias("direction"), F.col("src").alias("node")).distinct()
    return {"imports": out, "imported_by": back, "both": out.unionByName(back)}[direction]


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node)``."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def risk(total) -> F.Column:
    return F.when(total == 0, "low").when(total < 5, "medium").when(total < 20, "high").otherwise("critical")


def counts_by(edges: DataFrame, key: str, name: str) -> DataFrame:
    other = "dst" if key == "src" else "src"
    return edges.groupBy(F.col(key).alias("node")).agg(F.count_distinct(other).alias(name))


def context(nodes: DataFrame, *branches: DataFrame) -> DataFrame:
    """Left join of branches that are each one row a node, so that no branch multiplies another."""
    return reduce(lambda a, b: a.join(b, "node", "left"), branches, nodes)


def relabel(nodes: DataFrame, label: str, old: str, new: str, key: str, keys: list[str]) -> DataFrame:
    """Nodes with ``old`` labels under ``new`` ones, and a key from the first of ``keys`` that is there; called with the labels swapped it undoes itself."""
    return nodes.withColumn(key, F.coalesce(*keys)).withColumn(label, F.when(F.col(label) == old, new).otherwise(F.col(label)))
