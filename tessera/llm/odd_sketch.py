"""Operator 12: near-duplicates by MinHash bands, verified by odd sketches, then on whole sets.

A document's set holds hashes of 64 bits of its distinct shingles.  ``BANDS * ROWS`` MinHash values are banded for candidates.  The ``SAMPLES`` smallest hashes of a set, its
MinHash samples, are folded into an odd sketch: each flips one of ``BITS`` bits.  The ones in the XOR of two sketches are at most the samples that differ, and
nearly as many where few do.  For sets of up to ``SAMPLES`` shingles the samples are the set, so a pair with more ones than its sizes allow is surely below the threshold; for
larger sets the bound is one that a pair at the threshold exceeds with a chance of at most ``MISS``.  Pairs within the bound are settled by intersection and union of whole sets.  At a
similarity of 0.85 a pair meets in no band with a chance of 7e-9; nothing else is lost.

Rows with equal sets are one set, so copies are never paired.  In a bucket nobody is paired with everybody: sets known to be one class are not compared again, and sketches are compared inside the join, so a pair that cannot link is never a row.
First one leader of each bucket of the first ``FIRST`` bands (the set in the largest buckets) meets the others.  Then ``PASSES`` go over the buckets that still hold two classes, the closest pairs and few bands first, so that a
dense group is one class before its looser pairs are looked at; the last pass takes all bands at the threshold itself.

Defined cases: a null text and a text without words has the empty set and is linked with nothing; fewer words than a shingle make one shingle; a very long text is read whole; equal rows, and rows with one id, are rows of their own whose class is
that of their set; component_id is the smallest doc_id of the class, a null id counts as the largest; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, row_key, small_batches, work_table
from tessera.llm.textkernel import Block, Hasher, U, blocks, lowered, mix

SHINGLE, SIMILARITY = 5, 85
BANDS, ROWS, FIRST = 32, 5, 2
SAMPLES, BITS, MISS = 512, 1024, 1e-9
#: (bands, part of the way from the threshold to equality that a pair's sketches must reach) of each pass.
PASSES = ((4, 0.5), (8, 0.0), (BANDS, 0.0))
MAX_BROADCAST = 100_000
#: Names of sets, a number each, that go to every task.
MAX_IDS = 1_000_000
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each document of a lower-cased block."""
    start, end, before = block.words()
    if not len(start):
        return np.zeros(0, U), np.zeros(block.n + 1, np.int64)
    word = Hasher(block.data, 7)(start, end)
    n = np.diff(before)
    many = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    doc = np.repeat(np.arange(block.n), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + before[doc]
    h, stop = np.zeros(len(doc), U), before[doc + 1]
    for i in range(size):
        inside = at + i < stop
        h = mix(h * U(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at + i, len(word) - 1)], U(0)) + inside.astype(U))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    return h[new], np.searchsorted(doc[new], np.arange(block.n + 1))


def samples(h: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples of 32 bits, one row for each set; all sets hold something."""
    rng = np.random.default_rng(12)
    odd, flip = rng.integers(0, 1 << 32, (2, count), np.uint64).astype(np.uint32)
    x, out = (h >> U(32)).astype(np.uint32), np.empty((count, len(off) - 1), np.uint32)
    for i in range(count):
        out[i] = np.minimum.reduceat((x ^ flip[i]) * (odd[i] | np.uint32(1)), off[:-1])
    return out.T


def bands(s: np.ndarray) -> np.ndarray:
    """A key of 64 bits for each band of each row of samples."""
    key = np.arange(BANDS, dtype=U) * U(0xD6E8FEB86659FD93)
    out = np.broadcast_to(key, (len(s), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + s[:, r::ROWS].astype(U))
    return out.view(np.int64)


def sketches(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Odd sketches as ``BITS / 64`` numbers: each of the smallest ``SAMPLES`` hashes flips one bit."""
    out = np.zeros((len(off) - 1, BITS // 64), np.int64)
    for at in range(0, len(off) - 1, 1024):
        o = off[at : at + 1025]
        part, doc = h[o[0] : o[-1]], np.repeat(np.arange(len(o) - 1), np.diff(o))
        on = np.arange(len(part)) + o[0] - o[:-1][doc] < SAMPLES
        bit = (mix(part[on] + U(5)) % U(BITS)).astype(np.int64)
        ones = np.bincount(doc[on] * BITS + bit, minlength=(len(o) - 1) * BITS) & 1
        out[at : at + 1024] = np.packbits(ones.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.int64)
    return out


def most_ones(a: F.Column, b: F.Column, similarity: float) -> F.Column:
    """Ones in the XOR of the sketches of sets of ``a`` and ``b`` shingles that a pair of this similarity (of 1) does not exceed.

    Above ``SAMPLES`` shingles the samples that differ are at most twice those of the larger set outside the other: draws without replacement, held by Bernstein's bound.
    """
    both, large, slack = a + b, F.greatest(a, b), F.lit(log(1 / MISS))
    p = 1 - similarity / (1 + similarity) * both / large
    drawn = SAMPLES * p + slack / 3 + F.sqrt((slack / 3) ** 2 + 2 * slack * SAMPLES * p * (1 - p))
    return F.when(large <= SAMPLES, (1 - similarity) / (1 + similarity) * both + 1e-9).otherwise(2 * drawn)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, f1, f2, bands, s0..) of each row; f1 and f2 name its set."""
    names = ["doc_id", "key", "n", "f1", "f2", "bands", *SKETCH]

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(2)):
                h, off = sets(Block(lowered(b.data), b.off, b.first))
                n = np.diff(off)
                on = np.flatnonzero(n)
                f, band, sketch = np.zeros((2, b.n), U), np.zeros((0, BANDS), np.int64), np.zeros((b.n, len(SKETCH)), np.int64)
                if len(on):
                    starts = off[:-1][on]
                    f[0, on], f[1, on] = np.add.reduceat(h, starts), np.bitwise_xor.reduceat(mix(h + U(1)), starts)
                    s = samples(h, np.append(starts, len(h)), BANDS * ROWS)
                    band, sketch[on] = bands(s), sketches(h, np.append(starts, len(h)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n > 0)) * BANDS, pa.int32()), pa.array(band.ravel()))
                part = batch.slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), *map(pa.array, f.view(np.int64)), lists, *(pa.array(sketch[:, i]) for i in range(len(SKETCH)))], names)

    schema = "doc_id long, key long, n long, f1 long, f2 long, bands array<long>, " + ", ".join(f"{x} long" for x in SKETCH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").alias("__text")).mapInArrow(run, schema)


def whole_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(rid, g): the sorted hashes of the sets that ``need(rid, none, low, key)`` names by one of their rows."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, off = sets(Block(lowered(b.data), b.off, b.first))
                yield pa.RecordBatch.from_arrays([batch.slice(b.first, b.n).column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))], ["rid", "g"])

    need = work_table(need, "set-names")
    few = F.broadcast(need) if need.count() <= MAX_BROADCAST else need
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("low"), row_key().alias("key"), "text")
    return rows.join(few, ["none", "low", "key"]).select("rid", "text").mapInArrow(run, "rid long, g array<long>").dropDuplicates(["rid"])


class Search:
    """The state of one search: ``sets`` (rid, n, names, bands, sketches), ``label`` (rid, comp) and the whole sets read so far."""

    def __init__(self, docs: DataFrame, found: DataFrame, similarity: int):
        self.docs, self.similarity = docs, similarity
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("low"), "key")).alias("row")
        same = found.where("n > 0").groupBy("f1", "f2", "n").agg(first, *[F.first(c).alias(c) for c in ("bands", *SKETCH)])
        self.sets = work_table(same.withColumn("rid", F.monotonically_increasing_id()), "sets")
        self.label = self.sets.select("rid", F.col("rid").alias("comp"))
        self.whole: DataFrame | None = None

    def bucketed(self, of) -> DataFrame:
        """(key, rid, comp) of the bands that ``of`` leaves: lists of bands meet their class before they are rows, and rows are dealt by key once for all that groups or joins them."""
        return self.sets.select("rid", of("bands").alias("bands")).join(self.label, "rid").select("rid", "comp", F.explode("bands").alias("key")).repartition("key")

    def open_buckets(self, placed: DataFrame, size: bool = False) -> DataFrame:
        """(key, rid, comp, n, s0..) of the rows in buckets of two classes or more; with the bucket's size if asked for."""
        keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", *(["members"] if size else []))
        return work_table(placed.join(keys, "key").join(self.sets.select("rid", "n", *SKETCH), "rid"), "buckets")

    def near(self, a, b, closer: float = 0.0) -> F.Column:
        """Different classes, sizes that allow the similarity, and sketches that allow it, or ``closer`` of the way from it to equality."""
        ones = reduce(lambda x, y: x + y, [F.bit_count(a(s).bitwiseXOR(b(s))) for s in SKETCH])
        least = self.similarity / 100 + closer * (1 - self.similarity / 100)
        return (a("comp") != b("comp")) & (100 * F.least(a("n"), b("n")) >= self.similarity * F.greatest(a("n"), b("n"))) & (ones <= most_ones(a("n"), b("n"), least))

    def led(self, rows: DataFrame, leaders: DataFrame) -> DataFrame:
        """Candidates: each row beside its bucket's leader."""
        pairs = rows.join(leaders, "key").where(self.near(lambda c: F.col(f"leader.{c}"), F.col))
        return pairs.select(F.least("rid", "leader.rid").alias("a"), F.greatest("rid", "leader.rid").alias("b"))

    def left(self, rows: DataFrame, closer: float) -> DataFrame:
        """Candidates: the pairs of different classes within a bucket, at least so close by their sketches."""
        x, y = rows.alias("x"), rows.alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid")) & self.near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), closer))
        return pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))

    def link(self, candidates: DataFrame) -> None:
        """Settle candidates on whole sets and merge the classes that they link."""
        pairs = work_table(candidates.distinct(), "candidates")
        asked = work_table(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "pair-sets")
        need = asked
        if self.whole is not None:
            need = need.join(self.whole.select("rid"), "rid", "left_anti")
        got = work_table(whole_sets(self.docs, self.sets.join(need, "rid").select("rid", "row.none", "row.low", "row.key")), "whole-sets")
        self.whole = got if self.whole is None else self.whole.unionByName(got)
        # sets that earlier pairs have read stay where they are
        few = F.broadcast(asked) if asked.count() <= MAX_IDS else asked
        whole = self.whole.join(few, "rid", "left_semi")
        g = lambda c: whole.select(F.col("rid").alias(c), F.col("g").alias(f"g{c}"))
        both = pairs.join(g("a"), "a").join(g("b"), "b").withColumn("shared", F.size(F.array_intersect("ga", "gb")))
        linked = both.where(100 * F.col("shared") >= self.similarity * (F.size("ga") + F.size("gb") - F.col("shared"))).select("a", "b")
        of = lambda c: self.label.select(F.col("rid").alias(c), F.col("comp").alias(f"c{c}"))
        edges = work_table(linked.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "links")
        if edges.isEmpty():
            return
        merged = components(edges).select(F.col("node").alias("comp"), "root")
        self.label = work_table(self.label.join(merged, "comp", "left").select("rid", F.coalesce("root", "comp").alias("comp")), "classes")

    def run(self) -> None:
        fields = ["rid", "comp", "n", *SKETCH]
        rows = self.open_buckets(self.bucketed(lambda b: F.slice(b, 1, FIRST)), size=True)
        score = rows.groupBy("rid").agg(F.sum("members").alias("score"))
        self.link(self.led(rows, rows.join(score, "rid").groupBy("key").agg(F.max(F.struct("score", *fields)).alias("leader"))))
        for bands, closer in PASSES:
            self.link(self.left(self.open_buckets(self.bucketed(lambda b: F.slice(b, 1, bands))), closer))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents link at ``similarity`` percent of shared shingles."""
    small_batches(docs.sparkSession)
    found = work_table(signatures(docs), "signatures")
    search = Search(docs, found, similarity)
    search.run()
    placed = search.sets.select("rid", "f1", "f2", "n", F.when(~F.col("row.none"), F.col("row.low")).alias("low")).join(search.label, "rid")
    lowest = placed.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = work_table(placed.join(lowest, "comp").select("f1", "f2", F.col("n").alias("m"), "component_id"), "set-classes")
    rows = found.select("doc_id", "n", "f1", "f2")
    linked = rows.where("n > 0").join(label.withColumnRenamed("m", "n"), ["f1", "f2", "n"]).select("doc_id", "n", "component_id")
    out = linked.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
