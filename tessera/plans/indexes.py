"""Searches through stored indexes: an inverted-file index of vectors for all rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import vector_index as VI
from tessera.sources.shared import FOUND, kept
from tessera.sources.tables import table

Q: dict = {}
EVERY, K = 100, 10
#: Recall that the probed lists reach on the rows whose id is divisible by ``TUNED_ON``; the queries are other rows but for common multiples.
RECALL, TUNED_ON = 0.95, 97


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def queries(spark, sf, every: int = EVERY) -> DataFrame:
    return vectors(spark, sf).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def vector_index(spark, sf) -> VI.VectorIndex:
    """The index of these files, kept for the application."""
    return VI.VectorIndex(spark, kept(vectors(spark, sf), "vector-index", lambda at: VI.build(vectors(spark, sf), at, "vec_id")), "vec_id")


def probes(spark, sf) -> int:
    """Lists a query that reach ``RECALL`` on another set of queries, measured once against the exact result."""
    index, folder = vector_index(spark, sf), kept(vectors(spark, sf), "vector-index", lambda at: None)
    if FOUND[folder] is None:
        tuned = queries(spark, sf, TUNED_ON)
        FOUND[folder] = index.probes_for(tuned, index.exact(tuned, K), RECALL)
    return FOUND[folder]


COS = """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score FROM p a JOIN p b ON a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10"""


@q("ivf_exact", COS)
def ivf_exact(spark, sf):
    """The ten nearest of each query: nearest lists first, then those that their radius cannot rule out."""
    return vector_index(spark, sf).exact(queries(spark, sf), K).select("qid", "vec_id", "score", "rank")


@q("ivf_search")
def ivf_search(spark, sf):
    """The ten nearest of each query within the lists that reach ``RECALL``; approximate, so without SQL."""
    return vector_index(spark, sf).search(queries(spark, sf), K, probes(spark, sf)).select("qid", "vec_id", "score", "rank")
