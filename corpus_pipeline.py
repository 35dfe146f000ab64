"""A training corpus in five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of documents.  ``run`` applies them in order to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from tessera.llm.common import row_key, work_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.quality_rules(docs, COLUMNS, only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; a null id counts as the largest."""
    return simhash.one_of_each_class(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that are found twice go from the texts; documents without text left go."""
    return suffix_dedup.remove_repeats(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix_sources(docs).where("copies > 0").groupBy("doc_id", "key", "source").agg(F.max("copies").alias("copies")).withColumnsRenamed({"doc_id": "__d", "key": "__k2", "source": "__s"})
    d = docs.select(*COLUMNS).withColumn("__k", row_key())
    out = d.join(taken, d["doc_id"].eqNullSafe(taken["__d"]) & (d["__k"] == taken["__k2"]) & d["source"].eqNullSafe(taken["__s"]))
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work_table(docs, f"stage-{i}")
    return docs


#: Suffix removal, hashing of shingles and packing have no SQL here; the stages are tested against brute force.
ORACLE_SQL = None
