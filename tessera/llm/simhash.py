"""Operator 3: SimHash near-duplicates with BK-trees.

Fingerprints are made per document in one Arrow pass.  Distinct fingerprints then go to shards: the 64 bits are cut into
``k`` blocks, and a fingerprint is sent to one shard for each choice of ``k - radius`` blocks, keyed by their bits.  Two
fingerprints that differ in at most ``radius`` bits agree on some choice, so each link is found in some shard, and none is lost.
``k`` grows with the number of fingerprints, so shards stay small.  A shard is one BK-tree: children keyed by the Hamming distance
to the parent; a search follows only edges within the radius.  A subtree known to be one class with the searched
fingerprint is skipped, so a dense group costs links in proportion to its size, not all pairs.
Shard trees sit beside their fingerprints instead of being broadcast: a broadcast of bounded batches of trees would read all fingerprints once a batch, so its work would grow with their square.

Defined cases: a null text, and a text without words, has fingerprint zero and is linked like any other; fewer than four words make one
shingle; a very long text is read whole, its shingles hashed in slices; a bit set in exactly half the shingles is 0; equal rows share a fingerprint; other columns, whatever their names, are ignored; among rows with one id the class id is that id; a null id counts as the largest and
is returned as null; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import components, fresh, row_key, small_batches, work_table
from tessera.llm.textkernel import Block, blocks, lowered

SHINGLE, SEED, RADIUS = 4, 42, 4
SHARD_SIZE = 32


def fingerprint(lower: bytes) -> int:
    """Fingerprint of one lower-cased text."""
    words = lower.split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start = (end - size)[: len(words) - SHINGLE + 1].tolist()
    stop = (end[SHINGLE - 1 :] - 1).tolist()
    got = np.fromiter((h(joined[a:b], SEED) for a, b in zip(start, stop)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(got), 65536):
        bits = np.unpackbits(got[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(got), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: bool = False) -> DataFrame:
    """(doc_id, fp long) of each row, with the row key if asked for."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                low = Block(lowered(b.data), b.off, b.first)
                fp = np.fromiter((fingerprint(low.text(i)) for i in range(low.n)), np.uint64, low.n).view(np.int64)
                part = batch.slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(batch.num_columns - 1)] + [pa.array(fp)], names)

    cols, names, schema = [F.col("doc_id")], ["doc_id", "fp"], "doc_id long, fp long"
    if key:
        cols, names, schema = [F.col("doc_id"), row_key().alias("key")], ["doc_id", "key", "fp"], "doc_id long, key long, fp long"
    return docs.select(*cols, F.col("text").alias("__text")).mapInArrow(run, schema)


class BKTree:
    """Fingerprints linked within a radius, as a union-find over positions of arrival."""

    __slots__ = ("fp", "kids", "up", "pure", "radius")

    def __init__(self, radius: int):
        self.fp, self.kids, self.up, self.pure, self.radius = [], [], [], [], radius

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, x: int) -> list[int]:
        """Insert a new fingerprint; the members of classes it joins, one each."""
        me, joined, fp, kids, up, pure, r = len(self.fp), [], self.fp, self.kids, self.up, self.pure, self.radius
        fp.append(x)
        kids.append({})
        up.append(me)
        pure.append(True)
        if not me:
            return joined
        stack = [0]
        while stack:
            i = stack.pop()
            if pure[i] and self.find(i) == self.find(me):
                continue
            d = (fp[i] ^ x).bit_count()
            if d <= r and (root := self.find(i)) != (mine := self.find(me)):
                up[max(root, mine)] = min(root, mine)
                joined.append(i)
            for e, kid in kids[i].items():
                if -r <= e - d <= r:
                    stack.append(kid)
        i, path = 0, []
        while True:
            path.append(i)
            d = (fp[i] ^ x).bit_count()
            if d not in kids[i]:
                kids[i][d] = me
                break
            i = kids[i][d]
        mine = self.find(me)
        for i in path:
            if pure[i] and self.find(i) != mine:
                pure[i] = False
        return joined


def block_choices(n: int, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> list[tuple[int, int]]:
    """(number, mask) of each choice of blocks; the fewest blocks that keep shards of evenly spread fingerprints small."""
    for k in range(radius + 2, 17):
        width, cut = [], 0
        for i in range(k):
            nxt = 64 * (i + 1) // k
            width.append((cut, nxt))
            cut = nxt
        picks = list(combinations(range(k), k - radius))
        bits = min(sum(width[i][1] - width[i][0] for i in p) for p in picks)
        if n / 2**bits <= shard_size or k == 16:
            break
    return [(j, sum((((1 << (width[i][1] - width[i][0])) - 1) << width[i][0]) for i in p)) for j, p in enumerate(picks)]


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that span, in each shard, the classes of distinct fingerprints within the radius."""
    picks = block_choices(n, radius)
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for j, m in picks])
    sharded = fps.select("fp", F.explode(keys).alias("s")).select("s.j", "s.bits", "fp")

    def search(batches):
        last, tree = None, None
        for pdf in batches:
            a, b = [], []
            for j, bits, fp in zip(pdf["j"].tolist(), pdf["bits"].tolist(), pdf["fp"].tolist()):
                if (j, bits) != last:
                    last, tree = (j, bits), BKTree(radius)
                for i in tree.add(fp & 0xFFFFFFFFFFFFFFFF):
                    a.append(fp)
                    y = tree.fp[i]
                    b.append(y - (1 << 64) if y >= 1 << 63 else y)
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return sharded.repartition("j", "bits").sortWithinPartitions("j", "bits", "fp").mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, key: bool = False) -> DataFrame:
    """doc_id, fp, component_id (and, if the row key is asked for, the key and the class root, a fingerprint) of every row."""
    small_batches(docs.sparkSession)
    fps = work_table(fingerprints(docs, key), "fingerprints")
    groups = work_table(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fp-groups")
    stars = components(links(groups.select("fp"), groups.count(), radius))
    member = stars.join(groups, stars["node"] == groups["fp"]).select("node", "root", "low")
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = member.join(low, "root").select(F.col("node").alias("fp"), "root", "component_id")
    root = [F.coalesce("root", "fp").alias("root")] if key else []
    label = work_table(groups.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), *root), "fp-classes")
    return fps.join(label, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class, one row with the smallest id.  The window works on the join's own partitions."""
    found = near_duplicates(docs, key=True)
    k, i, n = (fresh(docs, x) for x in ("__k", "__i", "__n"))
    number = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("key").alias(k))
    keep = keep.select(F.coalesce("component_id", F.lit(-(1 << 63)).cast("long")).alias(i), k)
    d = docs.withColumn(i, number).withColumn(k, row_key()).join(keep, [i, k], "left_semi")
    first = F.row_number().over(Window.partitionBy(i, k).orderBy(F.lit(0)))
    return d.withColumn(n, first).where(F.col(n) == 1).select(*docs.columns)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """As ``one_of_each``, but of each class by its root: classes that share an id, or have only null ids, keep a row each."""
    found = near_duplicates(docs, key=True)
    k, i, n = (fresh(docs, x) for x in ("__k", "__i", "__n"))
    number = lambda c: F.coalesce(c, F.lit(-(1 << 63)).cast("long"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"))
    keep = first.select(F.col("row.none").alias(n), number(F.col("row.doc_id")).alias(i), F.col("row.key").alias(k))
    d = docs.withColumns({n: F.col("doc_id").isNull(), i: number(F.col("doc_id")), k: row_key()}).join(keep, [n, i, k], "left_semi")
    once = F.row_number().over(Window.partitionBy(n, i, k).orderBy(F.lit(0)))
    return d.withColumn(n, once).where(F.col(n) == 1).select(*docs.columns)
