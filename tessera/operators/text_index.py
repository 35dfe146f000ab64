"""A stored full-text index: postings by token and block of documents, with block maxima.

Documents are dealt over blocks of about ``BLOCK`` by a hash of their key.  A row of ``postings`` is one token in one block: its documents in order of key, with counts and
lengths, and the largest saturated frequency in the block.  A token of a third of all documents is a row a block, so no row grows with the corpus.  Rows lie in
``PARTS`` folders by a hash of the token, in order of token, so a query opens the folders and row groups of its tokens and never a text.

Defined cases: a null text has no tokens but counts as a document; keys are taken to be unique, rows of one key count as one document; an empty table gives an index without postings.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.retrieval import bm25_tf
from tessera.sources.shared import FOUND, kept, stored

BLOCK, PARTS, SEEDS = 256, 16, 4
#: Blocks that a task of the build cuts into words, and documents that ask for another task a folder.
TASK_BLOCKS, FOLDER_DOCS = 16, 100_000
#: Room for the rounding of scores to six decimals.
SLACK = 1e-5


def part_of(token) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


WORD = re.compile("[a-z0-9_]+")


def block_postings(docs: pa.ChunkedArray, texts: pa.ChunkedArray, mean: float) -> tuple[list, np.ndarray, pa.Array, np.ndarray]:
    """(tokens, documents of each, their (doc, tf, len) in order of doc, largest saturated frequency of each) of one block of lower-cased texts; rows of one key are one document."""
    counts: dict = {}
    for doc, text in zip(docs.to_pylist(), texts.to_pylist()):
        counts.setdefault(doc, Counter()).update(WORD.findall(text or ""))
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    order = sorted(counts, key=lambda d: (d is not None, d))  # a null key comes first
    ids, tf = [], []
    for doc in order:
        ids.extend(map(number.__getitem__, counts[doc]))
        tf.extend(counts[doc].values())
    ids, tf = np.array(ids, np.int64), np.array(tf, np.int64)
    of = np.repeat(np.arange(len(order)), [len(counts[d]) for d in order])
    length = np.array([sum(counts[d].values()) for d in order], np.int64)[of]
    by = np.argsort(ids, kind="stable")
    n = np.bincount(ids, minlength=len(number))
    at = np.append(0, np.cumsum(n))
    most = np.maximum.reduceat(bm25_tf(tf, length, mean)[by], at[:-1]) if len(by) else np.zeros(0)
    held = pa.StructArray.from_arrays([pa.array(order, docs.type).take(pa.array(of[by])), pa.array(tf[by]), pa.array(length[by])], ["doc", "tf", "len"])
    return list(number), n, pa.ListArray.from_arrays(pa.array(at, pa.int32()), held), most


def build(docs: DataFrame, folder: str, key: str, text: str = "text") -> None:
    """Write ``folder/stats``, ``folder/terms`` and ``folder/postings``.

    Texts are shuffled once, by block; words are counted and listed inside their block in one pass over its texts, and only finished postings are shuffled again, by token.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    length = F.coalesce(F.regexp_count(F.lower("text"), F.lit("[a-z0-9_]+")), F.lit(0))
    sizes = d.select("doc", length.alias("len")).groupBy("doc").agg(F.sum("len").alias("len"))
    stats = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("len") / F.count("*"), F.lit(0.0)).alias("mean"))
    stats.coalesce(1).write.parquet(f"{folder}/stats")
    n, mean = spark.read.parquet(f"{folder}/stats").select("n", "mean").first()
    blocks = max(1, -(-n // BLOCK))
    placed = d.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks))).repartition(max(1, -(-blocks // TASK_BLOCKS)), "block")
    kind = docs.schema[key].dataType.simpleString()

    def post(at: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found, many, held, most = block_postings(rows["doc"], rows["text"], mean)
        cols = [pa.array([at[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.string()), held, pa.array(many, pa.int64()), pa.array(most, pa.float64())]
        return pa.Table.from_arrays(cols, ["block", "token", "docs", "n", "most"])

    rows = placed.withColumn("text", F.lower("text")).groupBy("block").applyInArrow(post, f"block long, token string, docs array<struct<doc:{kind},tf:bigint,len:bigint>>, n long, most double")
    folders = -(-n // FOLDER_DOCS) or 1
    full = rows.select(part_of("token").alias("part"), "token", "block", "docs", "n", "most").repartition(PARTS * folders, "part", F.pmod(F.hash("token"), F.lit(folders)))
    full.sortWithinPartitions("part", "token", "block").write.partitionBy("part").parquet(f"{folder}/postings")
    rows = spark.read.parquet(f"{folder}/postings")
    rows.groupBy("part", "token").agg(F.sum("n").alias("df")).sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{folder}/terms")


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.stats, self.terms, self.postings = (spark.read.parquet(f"{folder}/{x}") for x in ("stats", "terms", "postings"))

    def asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(item, token, part, idf, mean) of the distinct tokens of ``queries(item, token)`` that the index holds, and the postings in their folders."""
        q = queries.select("item", "token", part_of("token").alias("part")).distinct()
        idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = stored(self.terms.join(q, ["part", "token"]).crossJoin(F.broadcast(self.stats)).select("item", "token", "part", idf.alias("idf"), "mean"), "asked")
        return asked, self.postings.where(F.col("part").isin([r[0] for r in asked.select("part").distinct().collect()]))  # at most PARTS

    def scores(self, asked: DataFrame, opened: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """(item, doc, terms, score) of all documents that hold a token, or those of ``blocks(item, block)``.

        Postings are shuffled as they are, by block, and meet the queries there: a document's hits add up in its block.
        """
        if blocks is None:
            rows = opened.join(F.broadcast(asked), ["part", "token"])  # the words of the queries
        else:
            wanted = blocks.groupBy("block").agg(F.collect_set("item").alias("items"))
            rows = opened.join(F.broadcast(asked.select("part", "token").distinct()), ["part", "token"], "left_semi").join(wanted, "block")
            rows = rows.join(F.broadcast(asked), ["part", "token"]).where(F.array_contains("items", F.col("item")))
        hit = rows.select("block", "item", "idf", "mean", F.explode("docs").alias("d")).select("block", "item", F.col("d.doc").alias("doc"), (F.col("idf") * bm25_tf(F.col("d.tf"), F.col("d.len"), F.col("mean"))).alias("w"))
        return hit.groupBy("block", "item", "doc").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 6).alias("score")).drop("block")

    def top_k(self, queries: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
        """(item, doc, terms, score, rank): the k best documents of each query.

        The blocks with the highest bounds are scored first; their k-th score then drops the blocks whose bound lies below it.
        """
        asked, opened = self.asked(queries)
        bounds = opened.select("part", "token", "block", "most").join(asked, ["part", "token"]).groupBy("item", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        bounds = stored(bounds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))), "bounds")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        best = lambda s: s.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        early = stored(best(self.scores(asked, opened, bounds.where(F.col("r") <= seeds))), "early")
        least = early.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        rest = bounds.where(F.col("r") > seeds).join(least, "item", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        return best(early.drop("rank").unionByName(self.scores(asked, opened, rest)))


def index_of(docs: DataFrame, key: str, text: str = "text") -> TextIndex:
    """The index of these files, kept for the application."""
    folder = kept(docs, f"text-index-{key}-{text}", lambda at: build(docs, at, key, text))
    if FOUND[folder] is None:
        FOUND[folder] = TextIndex(docs.sparkSession, folder)
    return FOUND[folder]
