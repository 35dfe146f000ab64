"""Vector, lexical and fused retrieval over ``embeddings``, ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V
from tessera.operators import retrieval as R
from tessera.operators import text_index as TI
from tessera.sources.shared import stored
from tessera.sources.tables import scoped, table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def points(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def probe(spark, sf, vec_id: int = 0) -> DataFrame:
    return scoped(points(spark, sf), vec_id=vec_id).select(F.col("embedding").alias("q"))


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")


TERMS = ["the", "license", "version", "released"]
COS = """
WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), pq AS (SELECT e AS q FROM p WHERE vec_id = 0),
s AS (SELECT vec_id, label, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS score FROM p, pq)"""


@q("vec_topk", COS + " SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk(spark, sf):
    return R.vector_top_k(points(spark, sf), probe(spark, sf), 10).select("vec_id", "label", "score")


@q("vec_topk_filtered", COS + " SELECT vec_id, label, score FROM s WHERE label IN (1, 3, 5) AND score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk_filtered(spark, sf):
    return R.vector_top_k(points(spark, sf).where(F.col("label").isin(1, 3, 5)), probe(spark, sf), 10, 0.1).select("vec_id", "label", "score")


@q("vec_topk_per_group", COS + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT vec_id, label, score, rank FROM r WHERE rank <= 3")
def vec_topk_per_group(spark, sf):
    return R.vector_top_k(points(spark, sf), probe(spark, sf), 3, per=["label"]).select("vec_id", "label", "score", F.col("rank").cast("long").alias("rank"))


@q("multi_project_search", COS + """, r AS (SELECT *, 'project-' || label AS project, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE label < 4)
SELECT project, vec_id, score FROM r WHERE rank <= 5 ORDER BY score DESC, vec_id LIMIT 8""")
def multi_project_search(spark, sf):
    hits = R.vector_top_k(points(spark, sf).where("label < 4"), probe(spark, sf), 5, per=["label"])
    return hits.select(F.concat(F.lit("project-"), F.col("label").cast("string")).alias("project"), "vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(8)


@q("tenant_search", COS + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE label IN (2, 4, 6))
SELECT label, vec_id, score FROM r WHERE rank <= 5 ORDER BY label, score DESC, vec_id LIMIT 12""")
def tenant_search(spark, sf):
    hits = R.vector_top_k(points(spark, sf).where(F.col("label").isin(2, 4, 6)), probe(spark, sf), 5, per=["label"])
    return hits.select("label", "vec_id", "score").orderBy("label", F.desc("score"), "vec_id").limit(12)


TWO_PHASE = COS + """, g AS (SELECT label, round(avg(score), 6) AS gs FROM s GROUP BY 1 ORDER BY gs DESC, label LIMIT 5),
h AS (SELECT s.*, row_number() OVER (PARTITION BY s.label ORDER BY score DESC, vec_id) AS r FROM s JOIN g ON s.label = g.label)
SELECT label, vec_id, score FROM h WHERE r <= 3 ORDER BY score DESC, vec_id LIMIT 10"""


@q("two_phase_search", TWO_PHASE)
def two_phase_search(spark, sf):
    """Directories (labels) first, then their members."""
    s = points(spark, sf).crossJoin(F.broadcast(probe(spark, sf))).select("vec_id", "label", F.round(V.cosine("embedding", "q"), 6).alias("score"))
    g = s.groupBy("label").agg(F.round(F.avg("score"), 6).alias("gs")).orderBy(F.desc("gs"), "label").limit(5)
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    hits = s.join(F.broadcast(g.select("label")), "label").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return hits.select("label", "vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(10)


@q("embedding_mean", """
WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 3), q AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id = 0),
m AS (SELECT i, avg(x) AS m FROM p GROUP BY 1) SELECT m.i::INT AS dim, round(0.5 * q.x + 0.5 * m, 6) AS value FROM m JOIN q ON m.i = q.i""")
def embedding_mean(spark, sf):
    """Half the query and half the mean of expansions, by dimension."""
    m = scoped(points(spark, sf), label=3).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    x = probe(spark, sf).select(F.posexplode("q").alias("i", "x"))
    return m.join(F.broadcast(x), "i").select((F.col("i") + 1).alias("dim"), F.round(0.5 * F.col("x").cast("double") + 0.5 * F.col("m"), 6).alias("value"))


@q("quantize_int8", """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_min(e) AS lo, greatest(list_max(e) - list_min(e), 1e-8) AS span FROM p)
SELECT vec_id, list_sum(list_transform(e, lambda x: round_even((x - lo) / span * 255, 0)))::BIGINT AS total, (64 * 4)::BIGINT AS bytes_before, 64::BIGINT AS bytes_after FROM m""")
def quantize_int8(spark, sf):
    d = points(spark, sf).withColumn("v", V.int8("embedding"))
    return d.select("vec_id", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), (F.size("embedding") * 4).cast("long").alias("bytes_before"), F.size("v").cast("long").alias("bytes_after"))


@q("quantize_binary", """
SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::BIGINT AS ones, list_reduce(list_transform(embedding[1:8], lambda x: (x > 0)::INT), lambda a, b: a * 2 + b)::INT AS first_byte FROM embeddings""")
def quantize_binary(spark, sf):
    d = points(spark, sf).withColumn("b", V.bits("embedding"))
    return d.select("vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x)).alias("ones"), F.col("b")[0].alias("first_byte"))


@q("quantize_int4", """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, list_transform(e, lambda x: round_even((x - list_min(e)) / greatest(list_max(e) - list_min(e), 1e-8) * 15, 0)::INT) AS l FROM p)
SELECT vec_id, (l[1] * 16 + l[2])::INT AS first_byte, list_sum(list_transform(l, lambda x, i: CASE WHEN i % 2 = 1 THEN x * 16 ELSE x END))::BIGINT AS total FROM m""")
def quantize_int4(spark, sf):
    d = points(spark, sf).withColumn("b", V.int4("embedding"))
    return d.select("vec_id", F.col("b")[0].alias("first_byte"), F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@q("hamming_topk", """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings), x AS (SELECT b AS q FROM b WHERE vec_id = 0)
SELECT vec_id, len(list_filter(list_zip(b, q), lambda p: p[1] <> p[2]))::INT AS distance FROM b, x ORDER BY distance, vec_id LIMIT 10""")
def hamming_topk(spark, sf):
    x = probe(spark, sf).select(V.bits("q").alias("qb"))
    return points(spark, sf).crossJoin(F.broadcast(x)).select("vec_id", V.hamming(V.bits("embedding"), F.col("qb")).alias("distance")).orderBy("distance", "vec_id").limit(10)


@q("quantized_search", COS + """, c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings), x AS (SELECT b AS q FROM c WHERE vec_id = 0),
h AS (SELECT vec_id FROM c, x ORDER BY len(list_filter(list_zip(b, q), lambda p: p[1] <> p[2])), vec_id LIMIT 50)
SELECT vec_id, score FROM s WHERE vec_id IN (SELECT vec_id FROM h) ORDER BY score DESC, vec_id LIMIT 10""")
def quantized_search(spark, sf):
    """Candidates by Hamming distance of bits, then exact scores."""
    x = F.broadcast(probe(spark, sf).select("q", V.bits("q").alias("qb")))
    c = points(spark, sf).crossJoin(x).withColumn("h", V.hamming(V.bits("embedding"), F.col("qb"))).orderBy("h", "vec_id").limit(50)
    return c.select("vec_id", F.round(V.cosine("embedding", "q"), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@q("compression_stats", "SELECT count(*) AS vectors, sum(len(embedding) * 4)::BIGINT AS original, sum(len(embedding))::BIGINT AS packed, round(sum(len(embedding) * 4) / sum(len(embedding))::DOUBLE, 6) AS ratio, round(100 * (1 - sum(len(embedding)) / sum(len(embedding) * 4)::DOUBLE), 6) AS saved, count(*) >= 1000 AS worthwhile FROM embeddings")
def compression_stats(spark, sf):
    n = F.size("embedding").cast("long")
    return points(spark, sf).agg(F.count("*").alias("vectors"), F.sum(n * 4).alias("original"), F.sum(n).alias("packed"), F.round(F.sum(n * 4) / F.sum(n), 6).alias("ratio"), F.round(100 * (1 - F.sum(n) / F.sum(n * 4)), 6).alias("saved"), (F.count("*") >= 1000).alias("worthwhile"))


TOK = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), n AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), c AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2)"


@q("bm25_tf", TOK + " SELECT c.doc_id, token, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 100.0)), 6) AS weight FROM c JOIN n ON c.doc_id = n.doc_id WHERE token IN ('the', 'license', 'version')")
def bm25_tf(spark, sf):
    """Sparse weights; the filter on tokens sits above the exploded counts."""
    t = R.term_counts(docs(spark, sf), "doc_id").where(F.col("token").isin("the", "license", "version"))
    return t.select("doc_id", "token", F.round(R.bm25_tf(F.col("tf"), F.col("len")), 6).alias("weight"))


BM25 = TOK + """, st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents)::DOUBLE AS avg), d AS (SELECT token, count(*) AS df FROM c WHERE token IN ('the', 'license', 'version', 'released') GROUP BY 1),
lex AS (SELECT c.doc_id, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM c JOIN d ON c.token = d.token JOIN n ON c.doc_id = n.doc_id, st GROUP BY 1)"""


def text_index(spark, sf) -> TI.TextIndex:
    return TI.index_of(table(spark, sf, "documents"), "doc_id")


def terms_of_query(spark) -> DataFrame:
    return spark.createDataFrame([(0, t) for t in TERMS], "item int, token string")


def lexical(spark, sf) -> DataFrame:
    """Scores of all documents that hold a term, from the stored index."""
    index = text_index(spark, sf)
    return index.scores(*index.asked(terms_of_query(spark))).select(F.col("doc").alias("doc_id"), "score")


@q("bm25_search", BM25 + " SELECT doc_id, score FROM lex ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark, sf):
    return text_index(spark, sf).top_k(terms_of_query(spark), 20).select(F.col("doc").alias("doc_id"), "score")


@q("fulltext_by_label", BM25 + " SELECT doc_id, lang, score FROM lex JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') ORDER BY score DESC, doc_id LIMIT 15")
def fulltext_by_label(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang").where(F.col("lang").isin("en", "de"))
    return lexical(spark, sf).join(d, "doc_id").select("doc_id", "lang", "score").orderBy(F.desc("score"), "doc_id").limit(15)


@q("many_query_bm25", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS token FROM benchmark), c AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN (SELECT token FROM b) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT c.doc_id, c.token, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS weight FROM c JOIN df ON c.token = df.token JOIN l ON c.doc_id = l.doc_id, g),
s AS (SELECT item_id, doc_id, count(*) AS terms, round(sum(weight), 6) AS score FROM b JOIN w ON b.token = w.token GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def many_query_bm25(spark, sf):
    """BM25 of all benchmark items, a stated query set, against all documents, from the stored index."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.explode(F.array_distinct(R.tokens("text"))).alias("token"))
    return text_index(spark, sf).top_k(b, 3).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "terms", "score", "rank")


@q("text_contains", "SELECT doc_id, 0.5::DOUBLE AS score FROM documents WHERE contains(text, 'License') OR contains(source, 'src13') ORDER BY doc_id LIMIT 50")
def text_contains(spark, sf):
    return docs(spark, sf).where(F.col("text").contains("License") | F.col("source").contains("src13")).select("doc_id", F.lit(0.5).alias("score")).orderBy("doc_id").limit(50)


@q("multi_label_contains", "SELECT 'document' AS label, doc_id AS id FROM documents WHERE contains(text, 'Version 2') UNION ALL SELECT 'page', page_id FROM pages WHERE contains(html, 'Version 2') OR contains(url, '/en/') UNION ALL SELECT 'part', p_partkey FROM part WHERE contains(p_name, '10')")
def multi_label_contains(spark, sf):
    one = lambda df, label, key, cond: df.where(cond).select(F.lit(label).alias("label"), F.col(key).alias("id"))
    return one(docs(spark, sf), "document", "doc_id", F.col("text").contains("Version 2")).unionByName(
        one(table(spark, sf, "pages"), "page", "page_id", F.col("html").contains("Version 2") | F.col("url").contains("/en/"))).unionByName(
        one(table(spark, sf, "part"), "part", "p_partkey", F.col("p_name").contains("10")))


@q("should_filter", "SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9_]+'), ['license', 'gnu', 'apache'])")
def should_filter(spark, sf):
    return docs(spark, sf).where(F.arrays_overlap(R.tokens("text"), F.array(*map(F.lit, ["license", "gnu", "apache"])))).select("doc_id")


@q("keyword_topn", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE length(token) > 2 AND token NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c) SELECT doc_id, token, n, rank FROM r WHERE rank <= 5")
def keyword_topn(spark, sf):
    t = scoped(docs(spark, sf), lang="en").select("doc_id", F.explode(R.tokens("text")).alias("token"))
    t = t.where((F.length("token") > 2) & ~F.col("token").isin("the", "and", "for", "with", "from", "that", "this"))
    c = t.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "token")).cast("long")).where("rank <= 5")


# Hits of three sources for one query: lexical, dense (by vector id = document id) and recency of the id.
HITS = BM25 + """, p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), pq AS (SELECT e AS q FROM p WHERE vec_id = 0),
den AS (SELECT vec_id AS doc_id, round(list_dot_product(e, q), 6) AS score FROM p, pq),
hits AS (SELECT 'dense' AS src, 0.7 AS w, doc_id, score FROM (SELECT * FROM den ORDER BY score DESC, doc_id LIMIT 40) UNION ALL SELECT 'lexical', 0.3, doc_id, score FROM (SELECT * FROM lex ORDER BY score DESC, doc_id LIMIT 40)),
hf AS (SELECT h.*, d.source || '/' || d.lang AS file FROM hits h JOIN documents d USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, doc_id) AS rank FROM hf)"""


def dense(spark, sf) -> DataFrame:
    return points(spark, sf).crossJoin(F.broadcast(probe(spark, sf))).select(F.col("vec_id").alias("doc_id"), F.round(V.dot("embedding", "q"), 6).alias("score"))


def hits(spark, sf) -> DataFrame:
    top = lambda df, src, w: df.orderBy(F.desc("score"), "doc_id").limit(40).select(F.lit(src).alias("src"), F.lit(w).alias("w"), "doc_id", "score")
    h = top(dense(spark, sf), "dense", 0.7).unionByName(top(lexical(spark, sf), "lexical", 0.3))
    d = docs(spark, sf).select("doc_id", F.concat_ws("/", "source", "lang").alias("file"))
    return stored(d.join(F.broadcast(h), "doc_id"), "hits")


@q("rrf_files", HITS + " SELECT file, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(DISTINCT src) AS num_sources, max_by(doc_id, (score, -rank, -doc_id)) AS best FROM rk GROUP BY 1 ORDER BY rrf DESC, file LIMIT 50")
def rrf_files(spark, sf):
    return R.rrf(hits(spark, sf), "file", "src", "doc_id").orderBy(F.desc("rrf"), "file").limit(50)


@q("rrf_points", HITS + " SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, max_by(src, src) AS payload_from FROM rk GROUP BY 1 ORDER BY rrf DESC, doc_id LIMIT 20")
def rrf_points(spark, sf):
    r = R.ranked(hits(spark, sf), "src", "doc_id")
    return r.groupBy("doc_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("rrf"), F.max("src").alias("payload_from")).orderBy(F.desc("rrf"), "doc_id").limit(20)


@q("rrf_weighted", HITS + " SELECT file, round(sum(w / (60 + rank)), 9) AS rrf, count(DISTINCT src) AS num_sources, max_by(doc_id, (score, -rank, -doc_id)) AS best FROM rk GROUP BY 1 ORDER BY rrf DESC, file LIMIT 50")
def rrf_weighted(spark, sf):
    """Weights change the fused score."""
    return R.rrf(hits(spark, sf), "file", "src", "doc_id", weight="w").orderBy(F.desc("rrf"), "file").limit(50)


@q("rrf_weighted_faithful", HITS + " SELECT file, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(DISTINCT src) AS num_sources, max_by(doc_id, (score * w, -rank, -doc_id)) AS best FROM rk GROUP BY 1 ORDER BY rrf DESC, file LIMIT 50")
def rrf_weighted_faithful(spark, sf):
    """Weights choose only the representative."""
    h = hits(spark, sf).withColumn("weighted", F.col("score") * F.col("w"))
    return R.rrf(h, "file", "src", "doc_id", score="weighted").orderBy(F.desc("rrf"), "file").limit(50)


@q("source_contributions", HITS + " SELECT file, src, round(max_by(1.0 / (60 + rank), rank), 9) AS contribution FROM rk GROUP BY 1, 2")
def source_contributions(spark, sf):
    r = R.ranked(hits(spark, sf), "src", "doc_id")
    return r.groupBy("file", "src").agg(F.round(F.max_by(1 / (R.RRF_K + F.col("rank")), "rank"), 9).alias("contribution"))


AGE = "(doc_id * 37 % 500)"
META = f"CASE doc_id % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'experimental' ELSE 'active' END AS status, CASE doc_id % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'model' WHEN 2 THEN 'config' ELSE 'other' END AS component, {AGE} AS age"


@q("metadata_boost", HITS + f""", b AS (SELECT file, doc_id, score, {META} FROM (SELECT * FROM rk ORDER BY score DESC, doc_id, src LIMIT 40))
SELECT doc_id, round(score * CASE WHEN age <= 30 THEN 1 + 0.3 * (1 - age / 30.0) ELSE 0.95 END * CASE status WHEN 'archived' THEN .2 WHEN 'deprecated' THEN .3 WHEN 'experimental' THEN .8 ELSE 1 END * CASE component WHEN 'service' THEN 1.1 WHEN 'model' THEN 1.05 WHEN 'config' THEN .95 ELSE 1 END, 6) AS boosted FROM b ORDER BY boosted DESC, doc_id LIMIT 20""")
def metadata_boost(spark, sf):
    h = hits(spark, sf).orderBy(F.desc("score"), "doc_id", "src").limit(40)
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ["archived", "deprecated", "experimental", "active", "active"])), (i % 5 + 1).cast("int"))
    component = F.element_at(F.array(*map(F.lit, ["service", "model", "config", "other"])), (i % 4 + 1).cast("int"))
    s = F.col("score") * R.recency_linear(i * 37 % 500) * R.lookup(R.STATUS, status) * R.lookup(R.COMPONENT, component)
    return h.select("doc_id", F.round(s, 6).alias("boosted")).orderBy(F.desc("boosted"), "doc_id").limit(20)


@q("recency_step", HITS + f" SELECT doc_id, src, round(score * CASE WHEN {AGE} < 7 THEN 1.2 WHEN {AGE} < 30 THEN 1.1 WHEN {AGE} < 90 THEN 1.0 WHEN {AGE} < 365 THEN .95 ELSE .9 END * (1 - (doc_id % 3) * 0.1), 6) AS score FROM rk")
def recency_step(spark, sf):
    i = F.col("doc_id")
    return hits(spark, sf).select("doc_id", "src", F.round(F.col("score") * R.recency_step(i * 37 % 500) * (1 - (i % 3) * 0.1), 6).alias("score"))


PRISM = """, pd AS (SELECT doc_id, 0.3 / (1 + exp(-0.1 * (n_chars / 200.0 - 10))) + 0.25 / (1 + exp(-0.3 * (doc_id % 9 - 3))) + 0.25 * exp(-0.1 * (doc_id * 37 % 500)) + 0.2 * CASE lang WHEN 'en' THEN .9 ELSE .5 END AS prism FROM documents)"""


def prisms(spark, sf) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, sf).select("doc_id", R.prism(F.col("n_chars") / 200.0, i % 9, i * 37 % 500, F.when(F.col("lang") == "en", 0.9).otherwise(0.5)).alias("prism"))


@q("prism_top_files", "WITH z AS (SELECT 1)" + PRISM + " SELECT doc_id, round(prism, 6) AS prism FROM pd ORDER BY 2 DESC, doc_id LIMIT 10")
def prism_top_files(spark, sf):
    return prisms(spark, sf).select("doc_id", F.round("prism", 6).alias("prism")).orderBy(F.desc("prism"), "doc_id").limit(10)


@q("prism_boost", HITS + PRISM + " SELECT rk.doc_id, src, round(0.7 * score + 0.3 * coalesce(prism, .5), 6) AS score FROM rk LEFT JOIN pd ON rk.doc_id = pd.doc_id")
def prism_boost(spark, sf):
    h = F.broadcast(hits(spark, sf))
    return prisms(spark, sf).join(h, "doc_id", "right").select("doc_id", "src", F.round(0.7 * F.col("score") + 0.3 * F.coalesce("prism", F.lit(0.5)), 6).alias("score"))


KNEE = """, dr AS (SELECT src, rank, round(score - lead(score) OVER (PARTITION BY src ORDER BY score DESC, doc_id), 9) AS d FROM rk), kn AS (SELECT src, coalesce(max_by(rank, (coalesce(d, -1), -rank)), 1) AS k FROM dr GROUP BY 1)"""


@q("knee_trim", HITS + KNEE + " SELECT src, k FROM kn")
def knee_trim(spark, sf):
    return R.knee(hits(spark, sf), ["src"], "doc_id").select("src", F.col("k").cast("long").alias("k"))


@q("heuristic_rerank", HITS + KNEE + """, hr AS (SELECT rk.src, rk.doc_id, score, score + 0.01 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), ['license', 'version', 'released'])) AS rerank FROM rk JOIN kn ON rk.src = kn.src JOIN documents d ON rk.doc_id = d.doc_id WHERE rank <= greatest(k, 5))
SELECT src, doc_id, round(rerank, 6) AS rerank, row_number() OVER (PARTITION BY src ORDER BY rerank DESC, score DESC, doc_id) AS place FROM hr""")
def heuristic_rerank(spark, sf):
    h = hits(spark, sf)
    r = R.ranked(h, "src", "doc_id")
    k = F.broadcast(R.knee(h, ["src"], "doc_id"))
    r = r.join(k, "src").where(F.col("rank") <= F.greatest("k", F.lit(5)))
    terms = F.array(*[F.lit(x) for x in TERMS if len(x) > 3])
    d = docs(spark, sf).join(F.broadcast(r.select("src", "doc_id", "score")), "doc_id")
    d = d.withColumn("rerank", F.col("score") + 0.01 * F.size(F.array_intersect(R.tokens("text"), terms)))
    w = Window.partitionBy("src").orderBy(F.desc("rerank"), F.desc("score"), "doc_id")
    return d.select("src", "doc_id", F.round("rerank", 6).alias("rerank"), F.row_number().over(w).cast("long").alias("place"))


@q("rerank_gate", HITS + " SELECT src, count(*) AS n, round(avg(score), 6) AS confidence, count(*) >= 10 AND avg(score) <= 0.8 AS rerank FROM rk GROUP BY 1")
def rerank_gate(spark, sf):
    return hits(spark, sf).groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("confidence"), ((F.count("*") >= 10) & (F.avg("score") <= 0.8)).alias("rerank"))


KINDS = [("code", "function|class|def "), ("documentation", "license|version|guide"), ("error", "error|fail"), ("architecture", "system|design")]


@q("query_type", "SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in KINDS) + " ELSE 'general' END AS kind FROM benchmark")
def query_type(spark, sf):
    c = None
    for kind, pattern in KINDS:
        hit = F.lower("text").rlike(pattern)
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    return table(spark, sf, "benchmark").select("item_id", c.otherwise("general").alias("kind"))


@q("query_expansion", "SELECT item_id, n, template || text AS text FROM benchmark, (VALUES (1, 'How to use: '), (2, 'Example of '), (3, 'Explanation of ')) v(n, template)")
def query_expansion(spark, sf):
    t = spark.createDataFrame([(1, "How to use: "), (2, "Example of "), (3, "Explanation of ")], "n int, template string")
    return table(spark, sf, "benchmark").crossJoin(F.broadcast(t)).select("item_id", "n", F.concat("template", "text").alias("text"))


@q("hybrid_alpha", HITS + """, a AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.score, 0) AS ds, coalesce(l.score, 0) AS ls FROM (SELECT * FROM rk WHERE src = 'dense') d FULL JOIN (SELECT * FROM rk WHERE src = 'lexical') l ON d.doc_id = l.doc_id)
SELECT doc_id, round(0.5 * ds + 0.5 * ls, 6) AS score FROM a ORDER BY score DESC, doc_id LIMIT 15""")
def hybrid_alpha(spark, sf):
    h = hits(spark, sf).groupBy("doc_id").agg(F.sum(F.col("score") * 0.5).alias("s"))
    return h.select("doc_id", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(15)


@q("result_quality", HITS + """, x AS (SELECT rk.src, file, regexp_matches(lower(left(text, 200)), 'license|the ') AS hit, score > 0.2 AS strong FROM rk JOIN documents d ON rk.doc_id = d.doc_id)
SELECT src, round((avg(hit::INT) + avg(strong::INT)) / 2, 6) AS quality, count(DISTINCT file) AS files, CASE WHEN (avg(hit::INT) + avg(strong::INT)) / 2 >= .7 THEN 'high' WHEN (avg(hit::INT) + avg(strong::INT)) / 2 >= .4 THEN 'medium' ELSE 'low' END AS confidence FROM x GROUP BY 1""")
def result_quality(spark, sf):
    h = docs(spark, sf).select("doc_id", F.substring("text", 1, 200).alias("snippet")).join(F.broadcast(hits(spark, sf)), "doc_id")
    s = (F.avg(F.lower("snippet").rlike("license|the ").cast("int")) + F.avg((F.col("score") > 0.2).cast("int"))) / 2
    return h.groupBy("src").agg(F.round(s, 6).alias("quality"), F.count_distinct("file").alias("files"), F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low").alias("confidence"))


@q("result_filters", HITS + " SELECT doc_id, src, file FROM rk WHERE contains(file, 'src1') AND contains(lower(file), lower('EN'))")
def result_filters(spark, sf):
    return hits(spark, sf).where(F.col("file").contains("src1") & F.lower("file").contains("en")).select("doc_id", "src", "file")


@q("suffix_search", HITS + " SELECT doc_id, src, score FROM rk WHERE ends_with(file, '/en') OR ends_with(file, '/de') ORDER BY score DESC, doc_id, src LIMIT 20")
def suffix_search(spark, sf):
    return hits(spark, sf).where(F.substring_index("file", "/", -1).isin("en", "de")).select("doc_id", "src", "score").orderBy(F.desc("score"), "doc_id", "src").limit(20)


@q("snippets", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet, left(text, 1000) AS content FROM documents")
def snippets(spark, sf):
    return docs(spark, sf).select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("snippet"), F.substring("text", 1, 1000).alias("content"))


UNIFIED = HITS + """, us AS (SELECT 0 AS stage, doc_id, score FROM (SELECT * FROM den WHERE score >= 0.9 AND doc_id <> 0 ORDER BY score DESC, doc_id LIMIT 1000) UNION ALL SELECT 1, doc_id, round(sum(1.0 / (60 + rank)), 9) FROM rk GROUP BY 2),
uc AS (SELECT s.doc_id, s.score FROM us s JOIN documents d ON s.doc_id = d.doc_id WHERE stage = (SELECT min(stage) FROM us)),
ctx AS (SELECT d.doc_id, (SELECT count(*) FROM documents e WHERE e.source = d.source AND e.lang = d.lang) AS siblings FROM documents d),
b AS (SELECT c.doc_id, c.score, CASE WHEN siblings > 10 THEN .15 WHEN siblings > 5 THEN .08 WHEN siblings > 2 THEN .04 ELSE 0 END AS boost FROM uc c JOIN ctx ON c.doc_id = ctx.doc_id)
SELECT doc_id, round(score, 9) AS score, boost::DOUBLE AS boost, round(least(score * (1 + boost), 0.99), 9) AS final FROM b ORDER BY final DESC, doc_id LIMIT 10"""


def unified(spark, sf) -> DataFrame:
    """Cascade: strong dense hits, else fused lists; then context counts and the graph boost."""
    strong = dense(spark, sf).where("score >= 0.9 and doc_id <> 0").orderBy(F.desc("score"), "doc_id").limit(1000)
    fused = R.ranked(hits(spark, sf), "src", "doc_id").groupBy("doc_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("score"))
    c = F.broadcast(R.first_stage(strong, fused).select("doc_id", "score"))
    d = docs(spark, sf).select("doc_id", "source", "lang")
    x = stored(d.join(c, "doc_id"), "candidates")
    mine = F.broadcast(x.select("source", "lang").distinct())
    siblings = d.join(mine, ["source", "lang"], "left_semi").groupBy("source", "lang").agg(F.count("*").alias("siblings"))
    boost = R.graph_boost(F.col("siblings"), F.lit(0), F.lit(0), F.lit(0))
    x = x.join(siblings, ["source", "lang"]).withColumn("boost", boost)
    return x.select("doc_id", F.round("score", 9).alias("score"), "boost", F.round(R.boosted(F.col("score"), F.col("boost")), 9).alias("final")).orderBy(F.desc("final"), "doc_id").limit(10)


Q["unified_search"] = (unified, UNIFIED)


@q("memory_search", """
WITH h AS (SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), ['the', 'of', 'to']))::INT AS hits FROM conversations WHERE role = 'user')
SELECT conv_id, turn, hits FROM h WHERE hits > 0 ORDER BY hits DESC, conv_id, turn LIMIT 20""")
def memory_search(spark, sf):
    t = scoped(table(spark, sf, "conversations"), role="user")
    h = t.select("conv_id", "turn", F.size(F.array_intersect(R.tokens("text"), F.array(*map(F.lit, ["the", "of", "to"])))).alias("hits"))
    return h.where("hits > 0").orderBy(F.desc("hits"), "conv_id", "turn").limit(20)


@q("batch_rerank", """
WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT vec_id AS query_id, e AS q FROM p WHERE vec_id % 100 = 0),
c AS (SELECT query_id, vec_id, list_dot_product(e, q) AS dot, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) DESC, vec_id) AS near FROM p, x),
s AS (SELECT query_id, vec_id, round(dot, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 6) DESC, vec_id) AS r FROM c WHERE near <= 9 AND vec_id <> query_id)
SELECT query_id, vec_id, score, r AS place FROM s WHERE r <= 4""")
def batch_rerank(spark, sf):
    """Over-fetch per query, score, cut."""
    from tessera.plans.indexes import queries, vector_index

    near = vector_index(spark, sf).exact(queries(spark, sf), 9).where("vec_id <> qid").select(F.col("qid").alias("query_id"), "vec_id")
    point = lambda i, v: points(spark, sf).select(F.col("vec_id").alias(i), F.col("embedding").alias(v))
    s = near.join(point("vec_id", "e"), "vec_id").join(point("query_id", "q"), "query_id").select("query_id", "vec_id", F.round(V.dot("e", "q"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 4")


@q("mmr", HITS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, h AS MATERIALIZED (SELECT src, doc_id AS id, score, rank, n_chars::DOUBLE AS size FROM rk JOIN documents USING (doc_id)),
g AS (SELECT src, 1 AS place, [rank] AS taken, [size] AS sizes, id, score FROM h WHERE rank = 1
UNION ALL SELECT src, place, taken, sizes, id, score FROM (SELECT h.src, g.place + 1 AS place, list_append(g.taken, h.rank) AS taken, list_append(g.sizes, h.size) AS sizes, h.id, h.score,
  row_number() OVER (PARTITION BY h.src ORDER BY 0.85::DOUBLE * h.score + (1 - 0.85::DOUBLE) * list_min(list_transform(g.sizes, lambda x: abs(h.size - x) / greatest(h.size, x, 1.0::DOUBLE))) DESC, h.rank) AS best
  FROM g JOIN h ON h.src = g.src AND NOT list_contains(g.taken, h.rank) WHERE g.place < 10) WHERE best = 1)
SELECT src, id, score, place::BIGINT AS place FROM g""")
def mmr(spark, sf):
    h = docs(spark, sf).select("doc_id", "n_chars").join(F.broadcast(hits(spark, sf)), "doc_id")
    return R.mmr(h.select("src", F.col("doc_id").alias("id"), "score", F.col("n_chars").alias("size")), "src", 10)


@q("scroll", "SELECT vec_id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 100")
def scroll(spark, sf):
    return scoped(points(spark, sf), label=2).drop("embedding").orderBy("vec_id").limit(100)
