"""Job queues, dead letters, repairs, keyed writes and caches, over ``events``, ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import metrics as M
from tessera.operators import rules as X
from tessera.operators import sync as S
from tessera.operators.numbering import numbered
from tessera.sources.tables import table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


@q("enqueued_jobs", "SELECT event_id, to_json({'job_id': event_id, 'type': event_type, 'user': user_id}) AS job FROM events")
def enqueued_jobs(spark, sf):
    """Jobs as JSON lines, as a queue takes them."""
    job = F.to_json(F.struct(F.col("event_id").alias("job_id"), F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return events(spark, sf).select("event_id", job.alias("job"))


#: Category, retries and whether a person must look, by error class.
POLICIES = [("ConnectionError", "transient", 5, False), ("TimeoutError", "transient", 3, False), ("HTTPError", "service", 3, False), ("ValidationError", "permanent", 0, True), ("ValueError", "permanent", 0, True), ("AuthenticationError", "configuration", 1, True)]
UNKNOWN = ("unknown", 1, True)
CLASSES = [p[0] for p in POLICIES] + ["KeyError"]
JOBS = f"""
WITH policy(error_class, category, max_retries, manual) AS (VALUES {", ".join(f"('{c}', '{k}', {n}, {str(m).lower()})" for c, k, n, m in POLICIES)}),
j AS (SELECT event_id, ts, user_id, event_type <> 'view' AS failed, ({CLASSES})[(props->>'$.k')::INT % 7 + 1] AS error_class, (event_id % 5)::INT AS retry_count FROM events),
dlq AS (SELECT event_id, ts, user_id, j.error_class, retry_count, coalesce(category, 'unknown') AS category, coalesce(max_retries, 1)::INT AS max_retries, coalesce(manual, true) AS manual FROM j LEFT JOIN policy p ON j.error_class = p.error_class WHERE failed)"""


def jobs(spark, sf) -> DataFrame:
    """Jobs with an error class and how often they were tried; views succeed."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf).select("event_id", "ts", "user_id", (F.col("event_type") != "view").alias("failed"), F.element_at(F.array(*map(F.lit, CLASSES)), k % 7 + 1).alias("error_class"), (F.col("event_id") % 5).cast("int").alias("retry_count"))


def with_policy(failed: DataFrame) -> DataFrame:
    """Category, most retries and whether a person must look, by the error class; classes without a policy have one of their own."""
    out = failed
    for i, (name, default) in enumerate(zip(("category", "max_retries", "manual"), UNKNOWN), 1):
        known = F.create_map(*[F.lit(x) for p in POLICIES for x in (p[0], p[i])])
        out = out.withColumn(name, F.coalesce(F.try_element_at(known, F.col("error_class")), F.lit(default)))
    return out


def dead(spark, sf) -> DataFrame:
    return with_policy(jobs(spark, sf).where("failed").drop("failed"))


@q("dead_letters", JOBS + " SELECT * FROM dlq")
def dead_letters(spark, sf):
    """Failed jobs with their error policy."""
    return dead(spark, sf)


@q("newest_dead_letters", JOBS + " SELECT event_id, error_class, retry_count FROM dlq WHERE error_class = 'TimeoutError' ORDER BY ts DESC, event_id LIMIT 100")
def newest_dead_letters(spark, sf):
    return M.newest(dead(spark, sf).where("error_class = 'TimeoutError'"), 100, F.desc("ts"), F.col("event_id")).select("event_id", "error_class", "retry_count")


@q("retry_plan", JOBS + " SELECT event_id, CASE WHEN manual THEN 'manual' WHEN retry_count < max_retries THEN 'retry' ELSE 'exhausted' END AS action, CASE WHEN NOT manual AND retry_count < max_retries THEN least(60 * pow(2, retry_count), 3600)::BIGINT ELSE 0 END AS delay_s FROM dlq")
def retry_plan(spark, sf):
    """Retry, give up or leave to a person, with the delay doubling at each try."""
    again = ~F.col("manual") & (F.col("retry_count") < F.col("max_retries"))
    action = F.when(F.col("manual"), "manual").when(again, "retry").otherwise("exhausted")
    return dead(spark, sf).select("event_id", action.alias("action"), F.when(again, F.least(60 * F.pow(F.lit(2), F.col("retry_count")), F.lit(3600)).cast("long")).otherwise(0).alias("delay_s"))


@q("requeued_jobs", JOBS + """, asked AS (SELECT event_id FROM dlq WHERE user_id % 4 = 1)
SELECT event_id, 'queued' AS place, retry_count + 1 AS retry_count FROM dlq WHERE event_id IN (SELECT event_id FROM asked) UNION ALL SELECT event_id, 'dead', retry_count FROM dlq WHERE event_id NOT IN (SELECT event_id FROM asked)""")
def requeued_jobs(spark, sf):
    """Chosen jobs go back to the queue, one try older, and leave the dead letters."""
    d = dead(spark, sf).select("event_id", "user_id", "retry_count")
    asked = d.where("user_id % 4 = 1").select("event_id")
    back = d.join(asked, "event_id", "left_semi").select("event_id", F.lit("queued").alias("place"), (F.col("retry_count") + 1).alias("retry_count"))
    return back.unionByName(S.delete(d, asked, ["event_id"]).select("event_id", F.lit("dead").alias("place"), "retry_count"))


@q("drained_batches", "SELECT event_id, (row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) - 1) // 10 AS batch, count(*) OVER (PARTITION BY date_trunc('hour', ts)) > 800 AS warn FROM events")
def drained_batches(spark, sf):
    """Micro-batches of at most ten events within an hour, and whether the hour's queue was near its bound."""
    hour = Window.partitionBy(F.date_trunc("hour", "ts"))
    n = F.row_number().over(hour.orderBy("ts", "event_id"))
    return events(spark, sf).select("event_id", F.floor((n - 1) / 10).alias("batch"), (F.count("*").over(hour) > 800).alias("warn"))


@q("idle_reset_counter", """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT event_id, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) <= 3 AS allowed FROM s""")
def idle_reset_counter(spark, sf):
    """A tenant's counter starts anew after an idle hour; three calls are allowed on one count."""
    s = M.sessions(events(spark, sf).select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600)
    n = F.row_number().over(Window.partitionBy("user_id", "session").orderBy("ts", "event_id")).cast("long")
    return s.select("event_id", n.alias("n"), (n <= 3).alias("allowed"))


#: Different keys that a cache may see: each costs a column.
MAX_KEYS = 1000


@q("cache_outcomes", """
WITH a AS (SELECT event_id, user_id, event_type AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, lag(ts) OVER w AS last_ts, lag(i) OVER w AS last_i FROM a WINDOW w AS (PARTITION BY user_id, key ORDER BY ts, event_id)),
d AS (SELECT p.event_id, any_value(p.last_ts) AS last_ts, any_value(p.ts) AS ts, count(DISTINCT b.key) AS between_keys FROM p LEFT JOIN a b ON b.user_id = p.user_id AND b.i > p.last_i AND b.i < p.i GROUP BY 1)
SELECT event_id, CASE WHEN last_ts IS NULL THEN 'miss' WHEN epoch_us(ts) - epoch_us(last_ts) > 6 * 3600 * 1000000::BIGINT THEN 'expired' WHEN between_keys >= 2 THEN 'evicted' ELSE 'hit' END AS outcome FROM d""")
def cache_outcomes(spark, sf):
    """What a cache per tenant does at each access: entries expire after six hours, and of more than two keys the one used longest ago goes.

    Between two accesses of a key lie as many other keys as have their own last access after it, so one running maximum a key is enough.
    """
    e = events(spark, sf).select("event_id", "user_id", F.col("event_type").alias("key"), "ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("i", F.row_number().over(order))
    same = Window.partitionBy("user_id", "key").orderBy("i")
    e = e.withColumns({"last_ts": F.lag("ts").over(same), "last_i": F.lag("i").over(same)})
    keys = [r[0] for r in e.select("key").distinct().limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"over {MAX_KEYS} different keys")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    others = F.lit(0)
    for k in keys:
        latest = F.max(F.when(F.col("key") == k, F.col("i"))).over(upto)
        others = others + F.when((F.col("key") != k) & (latest > F.col("last_i")), 1).otherwise(0)
    age = M.micros("ts") - M.micros("last_ts")
    outcome = F.when(F.col("last_ts").isNull(), "miss").when(age > 6 * 3600 * 1_000_000, "expired").when(others >= 2, "evicted").otherwise("hit")
    return e.select("event_id", outcome.alias("outcome"))


CHUNK_EDGES = """
WITH c AS (SELECT doc_id, pos // 50 AS sequence FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) GROUP BY 1, 2),
e AS (SELECT 'doc:' || doc_id AS src, 'HAS_CHUNK' AS rel, 'chunk:' || doc_id || ':' || sequence AS dst, sequence FROM c)"""


def chunk_nodes(spark, sf) -> DataFrame:
    """(doc_id, sequence) of chunks of fifty lines."""
    lines = F.size(F.split("text", "\n"))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((lines - 1) / 50))).alias("sequence"))


def has_chunk(nodes: DataFrame) -> DataFrame:
    d = F.col("doc_id").cast("string")
    return nodes.select(F.concat(F.lit("doc:"), d).alias("src"), F.lit("HAS_CHUNK").alias("rel"), F.concat_ws(":", F.lit("chunk"), d, F.col("sequence").cast("string")).alias("dst"), "sequence")


@q("chunk_edges", CHUNK_EDGES + " SELECT * FROM e")
def chunk_edges(spark, sf):
    """Edges from documents to their chunks, written over an older state: a second run adds none."""
    now = has_chunk(chunk_nodes(spark, sf))
    old = has_chunk(chunk_nodes(spark, sf).where("doc_id % 3 = 0")).withColumn("sequence", F.lit(-1).cast("long"))
    return S.upsert(old, now, ["src", "rel", "dst"])


@q("merged_edges", "SELECT DISTINCT l_suppkey AS src, 'SUPPLIES' AS rel, l_partkey AS dst FROM lineitem")
def merged_edges(spark, sf):
    """Edges of two indexing runs, each once."""
    e = table(spark, sf, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("src"), F.lit("SUPPLIES").alias("rel"), F.col("l_partkey").alias("dst"))
    return e.unionByName(e).dropDuplicates(["src", "rel", "dst"])


@q("dual_write_outcomes", """
WITH w AS (SELECT doc_id, text IS NOT NULL AND text <> '' AS graph_ok, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AS vector_ok FROM documents)
SELECT doc_id, CASE WHEN NOT graph_ok THEN 'graph_failed' WHEN vector_ok THEN 'written' ELSE 'rolled_back' END AS outcome, CASE WHEN NOT graph_ok THEN 1 WHEN vector_ok THEN 2 ELSE 3 END::BIGINT AS steps, graph_ok AND vector_ok AS in_graph, graph_ok AND vector_ok AS in_vectors FROM w""")
def dual_write_outcomes(spark, sf):
    """Chunks written to two stores, the graph first: what the event log and both stores hold afterwards.  A chunk without text fails in the graph, one without a vector in the second store."""
    rows = table(spark, sf, "documents", "doc_id", "text").join(table(spark, sf, "embeddings", F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    graph, vectors, events = S.dual_write(rows, "doc_id", F.col("text").isNotNull() & (F.col("text") != ""), F.col("embedding").isNotNull(), ["text"], ["embedding"])
    held = lambda t, n: t.select("doc_id", F.lit(True).alias(n))
    d = events.groupBy("doc_id").agg(F.max_by("status", "step").alias("outcome"), F.count("*").alias("steps")).join(held(graph, "in_graph"), "doc_id", "left").join(held(vectors, "in_vectors"), "doc_id", "left")
    return d.select("doc_id", "outcome", "steps", F.coalesce("in_graph", F.lit(False)).alias("in_graph"), F.coalesce("in_vectors", F.lit(False)).alias("in_vectors"))


@q("upsert_batches", "SELECT (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100 AS batch, label, vec_id FROM embeddings")
def upsert_batches(spark, sf):
    """Points of a collection in batches of a hundred."""
    n = numbered(table(spark, sf, "embeddings", "vec_id", "label"), ["label"], ["vec_id"], ["vec_id"])
    return n.select(F.floor((F.col("n") - 1) / 100).alias("batch"), "label", "vec_id")


@q("deleted_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_by_ids(spark, sf):
    """Points of toxic documents go."""
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return S.delete(table(spark, sf, "embeddings", "vec_id", "label"), ids, ["vec_id"])


@q("removed_files", CHUNK_EDGES + """, gone AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT 'chunks' AS store, count(*) AS n_left FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'hashes', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)""")
def removed_files(spark, sf):
    """Removing files takes their chunks, vectors and hashes: rows left in each store."""
    gone = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    stores = [("chunks", chunk_nodes(spark, sf)), ("vectors", table(spark, sf, "embeddings", "vec_id").withColumnRenamed("vec_id", "doc_id")), ("hashes", table(spark, sf, "documents", "doc_id"))]
    left = [S.delete(d, gone, ["doc_id"]).agg(F.count("*").alias("n_left")).select(F.lit(n).alias("store"), "n_left") for n, d in stores]
    return left[0].unionByName(left[1]).unionByName(left[2])


@q("backfilled_chunks", "SELECT 'chunk:' || vec_id AS chunk_id, label, vec_id AS qdrant_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT 'doc:' || doc_id, -1, -1 FROM documents WHERE n_chars > 500")
def backfilled_chunks(spark, sf):
    """Graph chunks, and new ones for vectors that have none."""
    have = table(spark, sf, "documents", "doc_id", "n_chars").where("n_chars > 500").select("doc_id")
    new = S.delete(table(spark, sf, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "doc_id"), have, ["doc_id"])
    old = have.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit(-1).alias("label"), F.lit(-1).cast("long").alias("qdrant_id"))
    return new.select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("chunk_id"), "label", F.col("doc_id").alias("qdrant_id")).unionByName(old)


@q("repair_batches", """
WITH s AS (SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN e.vec_id IS NULL THEN 'copy_to_b' WHEN d.doc_id IS NULL THEN 'delete_orphan' WHEN d.n_chars % 10 <> e.label THEN 'copy_from_a' END AS action FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT id, action, (row_number() OVER (PARTITION BY action ORDER BY id) - 1) // 50 AS batch, ((row_number() OVER (PARTITION BY action ORDER BY id) - 1) // 50) // 4 AS minute FROM s WHERE action IS NOT NULL""")
def repair_batches(spark, sf):
    """Repairs in batches of fifty, four batches a minute for each kind of repair."""
    a = table(spark, sf, "documents", "doc_id", "n_chars").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 10).cast("string").alias("h"))
    b = table(spark, sf, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("h"))
    plan = S.repair_plan(S.compare(a, b, "id", "h"), "id")
    batch = F.floor((F.col("n") - 1) / 50)
    return numbered(plan, ["action"], ["id"], ["id"]).select("id", "action", batch.alias("batch"), F.floor(batch / 4).alias("minute"))


COMMITS = "WITH c AS (SELECT event_type || '/' || (user_id % 9) AS path, ts, user_id AS author, left(md5(event_id::VARCHAR), 8) AS sha, event_id FROM events), n AS (SELECT max(ts) AS now FROM events)"


@q("commit_metrics", COMMITS + " SELECT path, max(ts) AS last_modified, count(*) FILTER (ts >= now - INTERVAL 30 DAY) AS recent, count(DISTINCT author) AS authors, max_by(sha, (ts, event_id)) AS last_commit FROM c, n GROUP BY 1")
def commit_metrics(spark, sf):
    """Last change, recent commits, authors and last commit of each path of a commit log."""
    e = events(spark, sf)
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    c = e.select(F.concat_ws("/", "event_type", (F.col("user_id") % 9).cast("string")).alias("path"), "ts", "user_id", F.substring(F.md5(F.col("event_id").cast("string")), 1, 8).alias("sha"), "event_id").crossJoin(now)
    return c.groupBy("path").agg(F.max("ts").alias("last_modified"), F.count_if(F.col("ts") >= F.col("now") - F.expr("INTERVAL 30 DAY")).alias("recent"), F.count_distinct("user_id").alias("authors"), F.max_by("sha", F.struct("ts", "event_id")).alias("last_commit"))


#: Canon levels and their weights.
LEVELS = [("primary", 1.0), ("secondary", 0.7), ("reference", 0.4), ("deprecated", 0.1), ("experimental", 0.3)]


#: Rule files of projects: a line a supplier.
RULE_LINES = """
WITH r AS (SELECT s_suppkey AS line, 'project-' || s_nationkey AS project, CASE s_suppkey % 6 WHEN 0 THEN '# rule ' || s_suppkey WHEN 1 THEN '  ' WHEN 2 THEN 'dist/v' || s_suppkey || '/**' WHEN 3 THEN 'regex:^build/' || s_suppkey || '/.*'
  WHEN 4 THEN ' !deprioritize:*/p' || s_suppkey || '.md,0.' || (s_suppkey % 9 + 1) ELSE '!deprioritize:docs/' || s_suppkey || '/*' END AS text FROM supplier),
p AS (SELECT line, project, CASE WHEN starts_with(trim(text), '!deprioritize:') THEN 'deprioritize' ELSE 'exclude' END AS action, CASE WHEN starts_with(trim(text), 'regex:') THEN 'regex' ELSE 'glob' END AS kind,
  regexp_replace(trim(text), '^(!deprioritize:|regex:)', '') AS rest FROM r WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')),
parsed AS (SELECT line, project, action, kind, split_part(rest, ',', 1) AS pattern, CASE WHEN action = 'exclude' THEN 1.0 ELSE coalesce(nullif(split_part(rest, ',', 2), '')::DOUBLE, 0.5) END::DOUBLE AS weight FROM p)"""


def rule_lines(spark, sf) -> DataFrame:
    """(line, project, text) of the projects' rule files."""
    k = F.col("s_suppkey").cast("string")
    soft = F.concat(F.lit(" !deprioritize:*/p"), k, F.lit(".md,0."), (F.col("s_suppkey") % 9 + 1).cast("string"))
    n = F.col("s_suppkey") % 6
    text = F.when(n == 0, F.concat(F.lit("# rule "), k)).when(n == 1, "  ").when(n == 2, F.concat(F.lit("dist/v"), k, F.lit("/**"))).when(n == 3, F.concat(F.lit("regex:^build/"), k, F.lit("/.*"))).when(n == 4, soft).otherwise(F.concat(F.lit("!deprioritize:docs/"), k, F.lit("/*")))
    return table(spark, sf, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("line"), F.concat(F.lit("project-"), F.col("s_nationkey").cast("string")).alias("project"), text.alias("text"))


@q("parsed_rules", RULE_LINES + " SELECT * FROM parsed")
def parsed_rules(spark, sf):
    """Lines of rule files as rules: comments and blanks go; a penalty without a weight is a half."""
    return X.parsed(rule_lines(spark, sf))


@q("rule_counts", RULE_LINES + " SELECT project, action, count(*) AS n FROM parsed GROUP BY 1, 2")
def rule_counts(spark, sf):
    """Rules of each project by action."""
    return parsed_rules(spark, sf).groupBy("project", "action").agg(F.count("*").alias("n"))


@q("canon_weights", """
WITH l(level, usual) AS (VALUES """ + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in LEVELS) + """), e AS (SELECT s_suppkey AS entry, 'src/p' || s_suppkey || '/**' AS pattern, (['primary', 'secondary', 'reference', 'deprecated', 'experimental', 'unknown'])[s_suppkey % 6 + 1] AS level, CASE WHEN s_suppkey % 4 = 1 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS weight FROM supplier)
SELECT entry, pattern, e.level, round(coalesce(weight, usual, 0.5), 6)::DOUBLE AS weight FROM e LEFT JOIN l ON e.level = l.level""")
def canon_weights(spark, sf):
    """Entries of canon configurations with their weights: their own, else that of the level, else a half."""
    levels = F.broadcast(spark.createDataFrame(LEVELS, "level string, usual double"))
    k = F.col("s_suppkey")
    level = F.element_at(F.array(*[F.lit(x) for x, _ in LEVELS], F.lit("unknown")), (k % 6 + 1).cast("int"))
    e = table(spark, sf, "supplier", "s_suppkey").select(k.alias("entry"), F.concat(F.lit("src/p"), k.cast("string"), F.lit("/**")).alias("pattern"), level.alias("level"), F.when(k % 4 == 1, (k % 10) / 10.0).alias("weight"))
    return e.join(levels, "level", "left").select("entry", "pattern", "level", F.round(F.coalesce("weight", "usual", F.lit(0.5)), 6).alias("weight"))
