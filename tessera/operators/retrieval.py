"""Ranking, fusion and re-ranking.  Every order is total: score down, then the key up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V
from tessera.sources.shared import stored

#: Status and component factors of the metadata boost.
STATUS = {"archived": 0.2, "deprecated": 0.3, "experimental": 0.8}
COMPONENT = {"service": 1.1, "model": 1.05, "config": 0.95}
K1, B, RRF_K = 1.2, 0.75, 60


def vector_top_k(points: DataFrame, query: DataFrame, k: int, threshold: float | None = None, per: list[str] | None = None) -> DataFrame:
    """Exact cosine top k of ``points(vec_id, embedding, ..)`` for a one-row ``query(q)``; per group if ``per`` is given."""
    s = points.crossJoin(F.broadcast(query)).withColumn("score", F.round(V.cosine("embedding", "q"), 6)).drop("q", "embedding")
    if threshold is not None:
        s = s.where(F.col("score") >= threshold)
    if per:
        w = Window.partitionBy(*per).orderBy(F.desc("score"), "vec_id")
        return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return s.orderBy(F.desc("score"), "vec_id").limit(k)


def tokens(text) -> Column:
    """ASCII word tokens in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, tf, len): the exploded sparse form of a text."""
    t = docs.select(key, F.explode(tokens(text)).alias("token"))
    c = t.groupBy(key, "token").agg(F.count("*").alias("tf"))
    n = t.groupBy(key).agg(F.count("*").alias("len"))
    return c.join(n, key)


def bm25_tf(tf: Column, length: Column, average=100.0) -> Column:
    """Saturated term frequency without document frequencies."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def term_table(docs: DataFrame, terms: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, len, tf): length and the count of each term in one pass over the text, stored; texts without any term keep their length only."""
    t = F.lower(text)
    count = lambda x: F.when(t.contains(x), F.regexp_count(t, F.lit(f"(?<![a-z0-9_]){x}(?![a-z0-9_])"))).otherwise(0)
    size = F.coalesce(F.regexp_count(t, F.lit("[a-z0-9_]+")), F.lit(0))
    return stored(docs.select(key, size.alias("len"), F.array(*[F.coalesce(count(x), F.lit(0)) for x in terms]).alias("tf")), "terms")


def bm25(docs: DataFrame, terms: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, score) of documents that hold a query term, with inverse document frequencies and the true mean length.

    Statistics and scores both read the narrow term table, so the texts are read once; ``terms`` are single tokens.
    """
    d = term_table(docs, terms, key, text)
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("df"))
    s = d.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    parts = F.zip_with("tf", "df", lambda tf, df: F.when(tf > 0, F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * bm25_tf(tf, F.col("len"), F.col("avg"))).otherwise(0.0))
    return s.select(key, F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


def ranked(hits: DataFrame, source: str, key: str) -> DataFrame:
    w = Window.partitionBy(source).orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w))


def rrf(hits: DataFrame, item: str, source: str, key: str, k: int = RRF_K, weight: str | None = None, score: str = "score") -> DataFrame:
    """Reciprocal rank fusion per ``item`` over sources; hits of one item in one source add up.

    ``best`` is the key of the hit with the largest original score.  With ``weight`` the summand is weight / (k + rank).
    """
    r = ranked(hits, source, key)
    top = F.lit(1.0) if weight is None else F.col(weight)
    return r.groupBy(item).agg(
        F.round(F.sum(top / (k + F.col("rank"))), 9).alias("rrf"), F.count_distinct(source).alias("num_sources"),
        F.max_by(key, F.struct(F.col(score), -F.col("rank"), -F.col(key))).alias("best"))


def lookup(values: dict, column: Column, default: float = 1.0) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, column), F.lit(default))


def recency_linear(age_days: Column) -> Column:
    return F.when(age_days < 0, 1.0).when(age_days <= 30, 1 + 0.3 * (1 - age_days / 30)).otherwise(0.95)


def recency_step(age_days: Column) -> Column:
    return F.when(age_days < 7, 1.2).when(age_days < 30, 1.1).when(age_days < 90, 1.0).when(age_days < 365, 0.95).otherwise(0.9)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def prism(complexity: Column, in_degree: Column, age_days: Column, contextual: Column) -> Column:
    return 0.3 * sigmoid(0.1 * (complexity - 10)) + 0.25 * sigmoid(0.3 * (in_degree - 3)) + 0.25 * F.exp(-0.1 * age_days) + 0.2 * contextual


def knee(scores: DataFrame, per: list[str], key: str) -> DataFrame:
    """How many hits of each list stand before its largest drop: the first largest, at least 1."""
    w = Window.partitionBy(*per).orderBy(F.desc("score"), key)
    d = scores.withColumn("i", F.row_number().over(w)).withColumn("drop", F.col("score") - F.lead("score").over(w))
    return d.groupBy(*per).agg(F.coalesce(F.max_by("i", F.struct(F.when(F.col("drop").isNotNull(), F.round("drop", 9)).otherwise(-1.0), -F.col("i"))), F.lit(1)).alias("k"))


def graph_boost(imported_by: Column, functions: Column, calls: Column, classes: Column) -> Column:
    return (F.when(imported_by > 10, 0.15).when(imported_by > 5, 0.08).when(imported_by > 2, 0.04).otherwise(0.0)
            + F.when(functions > 5, 0.08).when(functions > 2, 0.04).otherwise(0.0)
            + F.when(calls > 15, 0.12).when(calls > 8, 0.06).when(calls > 3, 0.03).otherwise(0.0)
            + 0.05 * F.least(classes, F.lit(3)))


def boosted(score: Column, boost: Column) -> Column:
    return F.least(score * (1 + boost), F.lit(0.99))


def mmr(hits: DataFrame, per: str, k: int, lam: float = 0.85) -> DataFrame:
    """Greedy choice of k hits a list that trades relevance for difference in length.  ``hits(per, id, score, size)``; one bounded list a group."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        chosen, left = [0], list(range(1, len(pdf)))
        size, score = pdf["size"].to_numpy(float), pdf["score"].to_numpy(float)
        while left and len(chosen) < k:
            gain = [lam * score[i] + (1 - lam) * min(abs(size[i] - size[j]) / max(size[i], size[j], 1.0) for j in chosen) for i in left]
            chosen.append(left.pop(gain.index(max(gain))))
        return pdf.iloc[chosen[: min(k, len(pdf))]].assign(place=range(1, min(k, len(chosen)) + 1))[[per, "id", "score", "place"]]

    kind = dict(hits.dtypes)
    return hits.groupBy(per).applyInPandas(pick, f"{per} {kind[per]}, id long, score double, place long")


def first_stage(*stages: DataFrame) -> DataFrame:
    """Rows of the first stage that has any: a cascade without driver-side tests.  Every stage is evaluated once; stages are cut to their best hits beforehand, so little is stored."""
    out = None
    for i, s in enumerate(stages):
        s = s.withColumn("stage", F.lit(i))
        out = s if out is None else out.unionByName(s)
    out = stored(out, "stages")
    low = F.broadcast(out.agg(F.min("stage").alias("low")))
    return out.join(low, F.col("stage") == F.col("low")).drop("low")


def ranking(answer: Column, n: int) -> Column:
    """The order of n candidates that a model's answer names: numbers from 1 to n, each once, then those not named; an answer without any keeps the first order."""
    named = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(answer, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: x.between(1, n)))
    every = F.sequence(F.lit(1), F.lit(n))
    return F.coalesce(F.concat(named, F.array_except(every, named)), every)


def scored(hits: DataFrame, score: Column, k: int, per: list[str], key: str, cache: DataFrame | None = None, fallback: Column | None = None) -> DataFrame:
    """The best k of each list by a pluggable scorer, as (per, key, score, model_score, source).

    Candidates are the first max(3k, min(n, 50)) of a list.  ``cache(per, key, cached)`` holds scores by tenant and query; a candidate that is in it is not scored again.  Where the scorer gives null
    (it had no time, or failed), ``fallback`` stands in.  Ties go to the first-stage score, then the key.
    """
    w = Window.partitionBy(*per)
    order = w.orderBy(F.desc("score"), key)
    c = hits.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(w)}).where(F.col("_r") <= F.greatest(F.lit(3 * k), F.least("_n", F.lit(50))))
    c = c.withColumn("cached", F.lit(None).cast("double")) if cache is None else c.join(cache, [*per, key], "left")
    model = F.when(F.col("cached").isNull(), score)
    source = F.when(F.col("cached").isNotNull(), "cache").when(model.isNotNull(), "model").otherwise("fallback")
    value = F.coalesce("cached", model, fallback if fallback is not None else F.col("score"))
    c = c.withColumns({"model_score": F.round(value, 6), "source": source})
    place = F.row_number().over(w.orderBy(F.desc("model_score"), F.desc("score"), key))
    return c.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(*per, key, "score", "model_score", "source", "place")
