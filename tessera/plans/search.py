"""Search cascades, memory modes, pluggable re-ranking and query plumbing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import retrieval as R
from tessera.operators import rules as X
from tessera.plans.corpus import EXCL, FILES, PEN, RULES, files
from tessera.plans.indexes import queries, vector_index
from tessera.plans.retrieval import HITS, TERMS, dense, docs, hits, lexical, points
from tessera.sources.cache import ResultCache
from tessera.sources.shared import FOUND, stored
from tessera.sources.tables import table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def best(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "doc_id").limit(n)


CASCADE = HITS + """, dirs AS (SELECT d.source AS dir, avg(score) AS m FROM den JOIN documents d USING (doc_id) GROUP BY 1), xm AS (SELECT i, avg(x) AS m FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM p JOIN embeddings USING (vec_id) WHERE label = 3) GROUP BY 1),
xq AS (SELECT list(0.5 * pq.q[i] + 0.5 * m ORDER BY i) AS q FROM xm, pq), wide AS (SELECT vec_id AS doc_id, round(list_dot_product(e, q), 6) AS score FROM p, xq),
top AS (SELECT dir FROM dirs WHERE m >= {dir} ORDER BY m DESC, dir LIMIT 3),
sg AS (SELECT 0 AS stage, doc_id, score FROM (SELECT den.doc_id, score FROM den JOIN documents d USING (doc_id) JOIN top ON d.source = top.dir WHERE score >= {hit} ORDER BY score DESC, doc_id LIMIT 10)
UNION ALL SELECT 1, doc_id, score FROM (SELECT * FROM wide WHERE score >= {strong} ORDER BY score DESC, doc_id LIMIT 10)
UNION ALL SELECT 2, doc_id, score FROM (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM rk WHERE score >= {fused} GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10)
UNION ALL SELECT 3, doc_id, score FROM (SELECT * FROM den WHERE score >= {plain} ORDER BY score DESC, doc_id LIMIT 10)
UNION ALL SELECT 4, doc_id, score FROM (SELECT doc_id, 0.5 AS score FROM documents WHERE contains(text, 'License') ORDER BY doc_id LIMIT 10))
SELECT stage, doc_id, score::DOUBLE AS score FROM sg WHERE stage = (SELECT min(stage) FROM sg)"""


def expanded(spark, sf) -> DataFrame:
    """Scores of all points for the expanded query: half the query and half the mean of its synthetic documents (here: the vectors of one label), by dimension."""
    own = points(spark, sf).where("vec_id = 0").select(F.posexplode("embedding").alias("i", "x"))
    mean = points(spark, sf).where("label = 3").select(F.posexplode("embedding").alias("i", "y")).groupBy("i").agg(F.avg(F.col("y").cast("double")).alias("m"))
    both = own.join(mean, "i").select("i", (0.5 * F.col("x").cast("double") + 0.5 * F.col("m")).alias("v"))
    one = both.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("q"))  # as many values as a vector has
    return points(spark, sf).crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("doc_id"), F.round(V.dot("embedding", "q"), 6).alias("score"))


def cascade(spark, sf, dir: float, hit: float, strong: float, fused: float, plain: float) -> DataFrame:
    """Five stages, the first with any hit wins: files of the best directories, expanded query, fused lists, plain vectors, text in the graph."""
    d = dense(spark, sf)
    owner = docs(spark, sf).select("doc_id", F.col("source").alias("dir"))
    top = F.broadcast(d.join(owner, "doc_id").groupBy("dir").agg(F.avg("score").alias("m")).where(F.col("m") >= dir).orderBy(F.desc("m"), "dir").limit(3).select("dir"))
    by_dir = d.where(F.col("score") >= hit).join(owner, "doc_id").join(top, "dir").select("doc_id", "score")
    lists = R.ranked(hits(spark, sf), "src", "doc_id").where(F.col("score") >= fused).groupBy("doc_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("score"))
    text = docs(spark, sf).where(F.col("text").contains("License")).select("doc_id", F.lit(0.5).alias("score"))
    return R.first_stage(*[best(x, 10) for x in (by_dir, expanded(spark, sf).where(F.col("score") >= strong), lists, d.where(F.col("score") >= plain), text)]).select("stage", "doc_id", "score")


#: Thresholds under which each stage in turn is the first with a hit.
SETTINGS = {"cascade_directories": (-1.0, 0.2, 9.0, 9.0, 9.0), "cascade_expanded": (9.0, 9.0, 0.9, 9.0, 9.0), "cascade_fused": (9.0, 9.0, 9.0, 0.0, 9.0), "cascade_vectors": (9.0, 9.0, 9.0, 1e9, 0.3), "cascade_text": (9.0, 9.0, 9.0, 1e9, 9.0)}
for _name, _t in SETTINGS.items():
    Q[_name] = ((lambda spark, sf, t=_t: cascade(spark, sf, *t)), CASCADE.format(**dict(zip(("dir", "hit", "strong", "fused", "plain"), _t))))


@q("memory_modes", HITS + """, g AS (SELECT doc_id FROM documents WHERE contains(source, 'src1') ORDER BY doc_id LIMIT 3),
m AS (SELECT 'semantic' AS mode, doc_id, score FROM (SELECT * FROM den WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 8) UNION ALL SELECT 'keyword', doc_id, score FROM (SELECT * FROM lex ORDER BY score DESC, doc_id LIMIT 8)
UNION ALL SELECT 'rrf_hybrid', doc_id, score FROM (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM rk GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 8) UNION ALL SELECT k.mode, doc_id, 0.8 FROM g, (VALUES ('semantic'), ('keyword'), ('rrf_hybrid')) k(mode))
SELECT mode, doc_id, score::DOUBLE AS score FROM m""")
def memory_modes(spark, sf):
    """Memory search by vectors, by words and by both; three rows of the graph with a fixed score follow each.  The diverse mode is ``mmr``."""
    h = R.ranked(hits(spark, sf), "src", "doc_id").groupBy("doc_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("score"))
    graph = docs(spark, sf).where(F.col("source").contains("src1")).select("doc_id").orderBy("doc_id").limit(3).withColumn("score", F.lit(0.8))
    out = None
    for mode, found in (("semantic", dense(spark, sf).where("score >= 0.1")), ("keyword", lexical(spark, sf)), ("rrf_hybrid", h)):
        part = best(found, 8).select("doc_id", "score").unionByName(graph).select(F.lit(mode).alias("mode"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


@q("similar_functions", """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), x AS (SELECT vec_id AS qid, e AS q FROM p WHERE vec_id % 100 = 0),
c AS (SELECT qid, vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS score FROM p, x),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM c),
f AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS place FROM s WHERE r <= 21 AND vec_id <> qid AND vec_id IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)) SELECT qid, vec_id, score, place FROM f WHERE place <= 10""")
def similar_functions(spark, sf):
    """For each query function twice the wanted hits from the vector index, then those that are functions (here: parts of even size)."""
    from pyspark.sql.window import Window

    s = vector_index(spark, sf).exact(queries(spark, sf), 21).where("vec_id <> qid").drop("rank")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    functions = table(spark, sf, "part", "p_partkey", "p_size").where("p_size % 2 = 0").select(F.col("p_partkey").alias("vec_id"))
    near = s.join(functions, "vec_id", "left_semi")
    return near.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("qid", "vec_id", "score", "place")


@q("scored_rerank", HITS + """, cand AS (SELECT rk.*, count(*) OVER (PARTITION BY src) AS lot FROM rk), k AS (SELECT cand.*, CASE WHEN doc_id % 5 = 0 THEN 0.9 END AS cached, CASE WHEN doc_id % 7 <> 3 THEN len(list_filter(['the', 'license', 'version', 'released'], lambda x: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), x))) / 4.0 END AS model FROM cand JOIN documents USING (doc_id) WHERE rank <= greatest(15, least(lot, 50))),
v AS (SELECT src, doc_id, score, round(coalesce(cached, model, score / 10)::DOUBLE, 6) AS model_score, CASE WHEN cached IS NOT NULL THEN 'cache' WHEN model IS NOT NULL THEN 'model' ELSE 'fallback' END AS source FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY model_score DESC, score DESC, doc_id) AS place FROM v) SELECT * FROM o WHERE place <= 5""")
def scored_rerank(spark, sf):
    """Re-ranking by a scorer (here: the share of query words held), with cached scores and a fallback where the scorer gives none."""
    h = stored(hits(spark, sf).drop("file", "w").join(docs(spark, sf).select("doc_id", "text"), "doc_id"), "candidates")
    cache = h.where("doc_id % 5 = 0").select("src", "doc_id", F.lit(0.9).alias("cached"))
    words = R.tokens("text")
    share = sum((F.array_contains(words, t).cast("int") for t in TERMS), F.lit(0)) / float(len(TERMS))
    return R.scored(h, F.when(F.col("doc_id") % 7 != 3, share), 5, ["src"], "doc_id", cache, F.col("score") / 10)


#: Seconds that a result is good for, and how many are held.
CACHE_TTL, CACHE_MOST = 300, 50


@q("cached_search", HITS + " SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM rk GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 15")
def cached_search(spark, sf):
    """A fused search whose result is kept: asked again within its time, it is read, not searched for."""
    cache = FOUND.setdefault(("results", spark.sparkContext.applicationId), ResultCache(spark, CACHE_TTL, CACHE_MOST))
    fused = lambda: R.ranked(hits(spark, sf), "src", "doc_id").groupBy("doc_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("score"))
    return cache.get(("fused", sf, *TERMS), lambda: best(fused(), 15))


@q("parsed_rankings", """
WITH a AS (SELECT doc_id, 'Best is ' || (doc_id % 7) || ', then [' || (doc_id % 5 + 1) || '] and ' || (doc_id % 7) || '; not 12' AS answer FROM documents),
n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(answer, '[0-9]+'), lambda x: x::INT), lambda x: x BETWEEN 1 AND 5) AS l FROM a),
d AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM n)
SELECT doc_id, list_concat(l, list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(l, x))) AS ranking FROM d""")
def parsed_rankings(spark, sf):
    """Rankings read from a model's answers: the numbers named, each once, then the candidates not named in their first order."""
    k = F.col("doc_id")
    answer = F.concat(F.lit("Best is "), (k % 7).cast("string"), F.lit(", then ["), (k % 5 + 1).cast("string"), F.lit("] and "), (k % 7).cast("string"), F.lit("; not 12"))
    return table(spark, sf, "documents", "doc_id").select("doc_id", R.ranking(answer, 5).alias("ranking"))


@q("fused_pipeline", HITS + f""", fl AS (SELECT doc_id, path FROM ({FILES.strip().removeprefix("WITH files AS (").removesuffix(")")}) files),
k AS (SELECT src, h.doc_id, path, score * (1 - {PEN}) AS score FROM hits h JOIN fl USING (doc_id) WHERE NOT ({EXCL})), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, doc_id) AS rank FROM k),
f AS (SELECT path, sum(1.0 / (60 + rank)) AS rrf, min(doc_id) AS doc_id FROM r GROUP BY 1) SELECT path, round(rrf * CASE WHEN doc_id % 4 = 0 THEN 1.1 ELSE 1.0 END, 9) AS final FROM f ORDER BY final DESC, path LIMIT 20""")
def fused_pipeline(spark, sf):
    """Exclude, penalise, fuse, boost."""
    rules = X.rule_table(spark, RULES)
    h = hits(spark, sf).drop("file").join(files(spark, sf).select("doc_id", "path"), "doc_id")
    h = X.penalties(X.not_excluded(stored(h, "paths").withColumn("hit", F.monotonically_increasing_id()), rules), rules, "hit").withColumn("score", F.col("score") * (1 - F.col("penalty")))
    f = R.ranked(h, "src", "doc_id").groupBy("path").agg(F.sum(1 / (R.RRF_K + F.col("rank"))).alias("rrf"), F.min("doc_id").alias("doc_id"))
    return f.select("path", F.round(F.col("rrf") * F.when(F.col("doc_id") % 4 == 0, 1.1).otherwise(1.0), 9).alias("final")).orderBy(F.desc("final"), "path").limit(20)


#: The largest limits a caller may ask for, the largest number of hops, the shortest query.
LIMITS = {"semantic": 50, "hybrid": 25}
MAX_HOPS, SHORTEST = 3, 3


@q("clamped_arguments", """
WITH a AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'semantic' ELSE 'hybrid' END AS tool, (item_id * 7 % 90 - 5)::INT AS asked, (item_id % 6)::INT AS hops, length(trim(text, ' ')) >= 3 AS valid FROM benchmark)
SELECT item_id, tool, greatest(1, least(asked, CASE tool WHEN 'semantic' THEN 50 ELSE 25 END)) AS n, greatest(0, least(hops, 3)) AS hops, valid FROM a""")
def clamped_arguments(spark, sf):
    """Arguments of queries cut to their limits, and whether the query is long enough."""
    i = F.col("item_id")
    tool = F.when(i % 2 == 0, "semantic").otherwise("hybrid")
    most = F.when(i % 2 == 0, LIMITS["semantic"]).otherwise(LIMITS["hybrid"])
    b = table(spark, sf, "benchmark")
    return b.select("item_id", tool.alias("tool"), F.greatest(F.lit(1), F.least((i * 7 % 90 - 5).cast("int"), most)).alias("n"), F.greatest(F.lit(0), F.least((i % 6).cast("int"), F.lit(MAX_HOPS))).alias("hops"), (F.length(F.trim("text")) >= SHORTEST).alias("valid"))


#: Lead-ins of made-up answers, by type of query.
TEMPLATES = {"code": ["def example():\n    # ", "class Example:\n    # "], "documentation": ["# Guide\n\n", "## Reference\n\n"], "error": ["Error: ", "Fix: "], "architecture": ["The system has ", "Design: "], "general": ["", "About "]}


@q("expanded_queries", "WITH t(kind, n, lead) AS (VALUES " + ", ".join("('{}', {}, '{}')".format(k, i, x.replace("\n", "' || chr(10) || '")) for k, xs in TEMPLATES.items() for i, x in enumerate(xs, 1)) + """),
k AS (SELECT item_id, text, CASE WHEN regexp_matches(lower(text), 'function|class|def ') THEN 'code' WHEN regexp_matches(lower(text), 'license|version|guide') THEN 'documentation' WHEN regexp_matches(lower(text), 'error|fail') THEN 'error' WHEN regexp_matches(lower(text), 'system|design') THEN 'architecture' ELSE 'general' END AS kind FROM benchmark)
SELECT item_id, k.kind, n, lead || text AS text FROM k JOIN t ON k.kind = t.kind""")
def expanded_queries(spark, sf):
    """Made-up answers for each query, by its type, over its whole text."""
    from tessera.plans.retrieval import query_type

    t = spark.createDataFrame([(k, i, x) for k, xs in TEMPLATES.items() for i, x in enumerate(xs, 1)], "kind string, n int, lead string")
    b = table(spark, sf, "benchmark").join(query_type(spark, sf), "item_id")
    return b.join(F.broadcast(t), "kind").select("item_id", "kind", "n", F.concat("lead", "text").alias("text"))


def graph_sql(spark, nodes: DataFrame, edges: DataFrame, statement: str) -> DataFrame:
    """Any SQL over the views ``nodes`` and ``edges``."""
    return spark.sql(statement, nodes=nodes, edges=edges) if "{nodes}" in statement or "{edges}" in statement else spark.sql(statement)


@q("graph_statement", "SELECT n_name AS name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 1")
def graph_statement(spark, sf):
    """A free-form statement over nodes and edges."""
    nodes = table(spark, sf, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    edges = table(spark, sf, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("src"), F.lit("IN").alias("rel"), F.col("s_nationkey").cast("long").alias("dst"))
    return graph_sql(spark, nodes, edges, "SELECT n.name, count(*) AS suppliers FROM {edges} e JOIN {nodes} n ON e.dst = n.id WHERE e.rel = 'IN' GROUP BY 1 HAVING count(*) >= 1")
