"""Streaming queries over ``events``; each drains its input and is compared with the batch form in tests or SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.events import SESSION
from tessera.sources.files import enqueue, queue
from tessera.sources.tables import table
from tessera.streaming import processors as P
from tessera.streaming import states as A
from tessera.streaming import streams as S

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


@q("stream_debounce", SESSION + " SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n, CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE max_by(event_type, (ts, event_id)) END AS outcome FROM s GROUP BY user_id, session")
def stream_debounce(spark, sf):
    d = S.drain(S.debounce(S.event_stream(spark, sf), ["user_id"], "6 hours"), "complete")
    return d.select("user_id", F.unix_micros("started").alias("started_us"), "n", "outcome")


@q("stream_sampled", "SELECT epoch_us(date_trunc('hour', ts)) AS started_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_sampled(spark, sf):
    d = S.drain(S.sampled(S.event_stream(spark, sf), "1 hour"), "complete")
    return d.select(F.unix_micros("started").alias("started_us"), "event_type", "n", "mean")


@q("stream_once", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_once(spark, sf):
    d = S.drain(S.once(S.event_stream(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type"))
    return d.agg(F.count("*").alias("n"))


@q("stream_pipeline", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k FROM events WHERE event_type <> 'error' GROUP BY 1")
def stream_pipeline(spark, sf):
    """Tag, drop, parse: one query."""
    s = S.event_stream(spark, sf).where("event_type <> 'error'").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return S.drain(s).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


#: State machines as recursive SQL: one step an event of a user.
STEP = """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, {start}, ''::VARCHAR AS answer FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT e.user_id, e.i, e.event_id, {step} AS answer FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, user_id, answer FROM r WHERE i > 0"""


@q("stream_cooldown", STEP.format(start="NULL::DOUBLE AS last", step="CASE WHEN e.t - last < 10800 THEN last ELSE e.t END, CASE WHEN e.t - last < 10800 THEN 'ignored' ELSE 'accepted' END"))
def stream_cooldown(spark, sf):
    return S.drain(A.stateful(S.event_stream(spark, sf), "user_id", A.cooldown(3 * 3600)))


_LIVE = "list_filter(held, lambda x: x > e.t - 21600)"


@q("stream_rate_limit", STEP.format(start="[]::DOUBLE[] AS held", step=f"CASE WHEN len({_LIVE}) >= 2 THEN {_LIVE} ELSE list_append({_LIVE}, e.t) END, CASE WHEN len({_LIVE}) >= 2 THEN 'rejected' ELSE 'allowed' END"))
def stream_rate_limit(spark, sf):
    return S.drain(A.stateful(S.event_stream(spark, sf), "user_id", A.sliding_limit(2, 6 * 3600)))


_NEW = "(began IS NULL OR e.t - began >= 21600)"


@q("stream_fixed_limit", STEP.format(start="NULL::DOUBLE AS began, 0 AS n", step=f"CASE WHEN {_NEW} THEN e.t ELSE began END, CASE WHEN {_NEW} THEN 1 WHEN n >= 2 THEN n ELSE n + 1 END, CASE WHEN {_NEW} OR n < 2 THEN 'allowed' ELSE 'rejected' END"))
def stream_fixed_limit(spark, sf):
    return S.drain(A.stateful(S.event_stream(spark, sf), "user_id", A.fixed_limit(2, 6 * 3600)))


_OPEN = "(mode = 2 AND e.t - x < 43200)"
_HALF = "(mode = 2 AND e.t - x >= 43200)"
_TRIPS = f"(e.event_type = 'error' AND ({_HALF} OR x + 1 >= 2))"


@q("stream_breaker", STEP.format(start="0 AS mode, 0::DOUBLE AS x", step=f"""CASE WHEN {_OPEN} OR {_TRIPS} THEN 2 ELSE 0 END, CASE WHEN {_OPEN} THEN x WHEN {_TRIPS} THEN e.t WHEN e.event_type = 'error' THEN x + 1 ELSE 0 END,
CASE WHEN {_OPEN} OR {_TRIPS} THEN 'open' ELSE 'closed' END"""))
def stream_breaker(spark, sf):
    return S.drain(A.stateful(S.event_stream(spark, sf), "user_id", A.breaker(2, 12 * 3600)))


def until_the_end(spark, sf, gap: str) -> DataFrame:
    """The event stream, and one row that only moves time past the last timeout."""
    at = S.scratch(spark)
    end = table(spark, sf, "events").agg(F.min("user_id").alias("user_id"), (F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {gap}") + F.expr("INTERVAL 1 SECOND")).alias("ts")).where("ts is not null")
    end.write.parquet(at)
    tick = spark.readStream.schema("user_id long, ts timestamp").parquet(at).withColumn("tick", F.lit(True))
    return S.event_stream(spark, sf).select("user_id", "ts", F.lit(False).alias("tick")).unionByName(tick)


@q("stream_sessions", SESSION + " SELECT user_id AS key, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n, 'idle' AS reason FROM s GROUP BY user_id, session")
def stream_sessions(spark, sf):
    """Sessions of a user end by a timer, six hours after their last event; their state goes with them."""
    return S.drain(P.until_idle(until_the_end(spark, sf, "6 HOURS"), "user_id", "6 hours"))


@q("stream_batches", SESSION.replace("6 HOUR", "30 HOUR") + """, b AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1) // 10 AS batch FROM s)
SELECT user_id AS key, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n, CASE WHEN count(*) = 10 THEN 'full' ELSE 'idle' END AS reason FROM b GROUP BY user_id, session, batch""")
def stream_batches(spark, sf):
    """Batches of a user are flushed at ten events, or when none has come for thirty hours."""
    return S.drain(P.until_idle(until_the_end(spark, sf, "30 HOURS"), "user_id", "30 hours", 10))


@q("queue_roundtrip", "SELECT event_id, user_id, event_type, (props->>'$.k')::INT AS k FROM events WHERE event_type <> 'view'")
def queue_roundtrip(spark, sf):
    """Jobs put on a queue as JSON, one message a line, and taken off it by a stream."""
    at = S.scratch(spark)
    e = table(spark, sf, "events").where("event_type <> 'view'")
    enqueue(e.select("event_id", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k")), at)
    return S.drain(queue(spark, at, "event_id long, user_id long, event_type string, k int")).drop("raw")


#: Two versions of the files that ``documents`` stand for, and when each was seen.
SNAPSHOTS = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
one AS (SELECT source || '/' || doc_id AS path, md5(text) AS hash FROM d WHERE doc_id % 10 <> 3),
two AS (SELECT CASE WHEN doc_id % 13 = 4 THEN 'moved/' ELSE '' END || source || '/' || doc_id AS path, md5(CASE WHEN doc_id % 7 = 2 THEN text || ' edited' ELSE text END) AS hash FROM d WHERE doc_id % 11 <> 5)"""


def observations(spark, sf) -> DataFrame:
    """(path, hash, ts): what a scan saw at each of two times; paths that the second no longer has come with a null hash."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    one = d.where("doc_id % 10 <> 3").select("path", F.md5("text").alias("hash"))
    two = d.where("doc_id % 11 <> 5").select(F.when(F.col("doc_id") % 13 == 4, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).alias("hash"))
    gone = one.join(two, "path", "left_anti").select("path", F.lit(None).cast("string").alias("hash"))
    at = lambda df, s: df.withColumn("ts", F.timestamp_seconds(F.lit(s)))
    return at(one, 1000).unionByName(at(two.unionByName(gone), 2000))


@q("stream_changes", SNAPSHOTS + """,
c AS (SELECT two.path, two.hash, row_number() OVER (PARTITION BY two.hash ORDER BY two.path) AS k FROM two ANTI JOIN one ON one.path = two.path),
g AS (SELECT one.path, one.hash, row_number() OVER (PARTITION BY one.hash ORDER BY one.path) AS k FROM one ANTI JOIN two ON one.path = two.path)
SELECT coalesce(c.path, g.path) AS path, CASE WHEN c.path IS NOT NULL THEN g.path END AS from_path, CASE WHEN g.path IS NULL THEN 'created' WHEN c.path IS NULL THEN 'deleted' ELSE 'moved' END AS kind, coalesce(c.hash, g.hash) AS hash FROM c FULL JOIN g ON c.hash = g.hash AND c.k = g.k
UNION ALL SELECT two.path, NULL, 'modified', two.hash FROM one JOIN two ON one.path = two.path WHERE one.hash <> two.hash""")
def stream_changes(spark, sf):
    """Changes of the second scan over the first, from a stream of what the scans saw."""
    return watched(spark, sf, S.scratch(spark)).where(F.col("us") == 2_000_000_000).select("path", "from_path", "kind", "hash")


@q("stream_state", SNAPSHOTS + " SELECT path, hash FROM two")
def stream_state(spark, sf):
    """The hashes that the change stream has saved: those of the files of the second scan, read from its checkpoint."""
    at = S.scratch(spark)
    watched(spark, sf, at)
    held = S.saved_state(spark, at, 1, "last").select(F.explode(F.arrays_zip("value.paths", "value.hashes")).alias("f"))
    return held.select(F.col("f.paths").alias("path"), F.col("f.hashes").alias("hash")).where("path <> ''")


def watched(spark, sf, run: str) -> DataFrame:
    """All changes of both scans, by a run whose checkpoint lies at ``run``."""
    at = S.scratch(spark)
    o = observations(spark, sf)
    end = spark.createDataFrame([("", None, 3000)], "path string, hash string, s long").select("path", "hash", F.timestamp_seconds("s").alias("ts"))
    for step in (o.where(F.unix_seconds("ts") == 1000), o.where(F.unix_seconds("ts") == 2000), end):
        step.write.mode("append").parquet(at)
    seen = spark.readStream.schema("path string, hash string, ts timestamp").parquet(at)
    return S.drain(P.file_changes(seen), at=run)
