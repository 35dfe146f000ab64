"""Event log, metrics and stream-state queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import intervals as I
from tessera.operators import metrics as M
from tessera.sources.tables import scoped, table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def as_of(e: DataFrame) -> DataFrame:
    return F.broadcast(e.agg(F.max("ts").alias("now")))


def r6(c):
    return F.round(c, 6)


@q("event_history", "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def event_history(spark, sf):
    return scoped(ev(spark, sf), user_id=7).orderBy("ts", "event_id").select("event_id", "ts", "event_type", "value")


@q("failed_ops", "SELECT event_id, ts, user_id FROM events WHERE event_type IN ('error', 'purchase', 'signup') AND user_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 1000")
def failed_ops(spark, sf):
    e = ev(spark, sf).where(F.col("event_type").isin("error", "purchase", "signup") & (F.col("user_id") % 3 == 1) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return M.newest(e, 1000, F.desc("ts"), F.col("event_id")).select("event_id", "ts", "user_id")


@q("events_by_type", "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def events_by_type(spark, sf):
    return M.newest(scoped(ev(spark, sf), event_type="click"), 100, F.desc("ts"), F.col("event_id")).select("event_id", "ts", "user_id", "value")


@q("repair_history", """
SELECT * FROM (SELECT * FROM (SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25)
UNION ALL SELECT * FROM (SELECT event_id, ts, event_type FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id LIMIT 25)) ORDER BY ts DESC, event_id""")
def repair_history(spark, sf):
    e = ev(spark, sf).select("event_id", "ts", "event_type")
    a, b = (M.newest(scoped(e, event_type=k), 25, F.desc("ts"), F.col("event_id")) for k in ("error", "signup"))
    return a.unionByName(b).orderBy(F.desc("ts"), "event_id")


@q("dlq_stats", """
WITH d AS (SELECT *, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 1000)
SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS total, count(*) FILTER (k % 4 = 0) AS transient, count(*) FILTER (k % 4 = 1) AS permanent,
count(*) FILTER (k % 4 > 1) AS manual, round(count(*) FILTER (k % 4 > 1) / count(*)::DOUBLE, 6) AS manual_rate, round(avg(k % 5), 2) AS avg_retry FROM d""")
def dlq_stats(spark, sf):
    e = scoped(ev(spark, sf), event_type="error").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    d = M.newest(e, 1000, F.desc("ts"), F.col("event_id"))
    manual = F.count_if(F.col("k") % 4 > 1)
    out = d.agg(F.count_if(F.col("k") % 4 == 0).alias("transient"), F.count_if(F.col("k") % 4 == 1).alias("permanent"), manual.alias("manual"), r6(M.ratio(manual, F.count("*"))).alias("manual_rate"), F.round(F.avg(F.col("k") % 5), 2).alias("avg_retry"))
    return F.broadcast(e.agg(F.count("*").alias("total"))).crossJoin(out)


@q("error_stats", """
SELECT event_type, user_id % 4 AS severity, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2""")
def error_stats(spark, sf):
    e = ev(spark, sf)
    recent = e.join(as_of(e), F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS"))
    return recent.groupBy("event_type", (F.col("user_id") % 4).alias("severity")).agg(F.count("*").alias("n"))


LOAD = """
WITH s AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, avg(value) AS mean, list_sort(list(value)) AS v FROM events GROUP BY 1),
p AS (SELECT *, 0.95 * (total + 1) AS pos, greatest(1, least(floor(0.95 * (total + 1)), total - 1))::INT AS j FROM s)"""


@q("load_sessions", LOAD + """
SELECT user_id, total, ok, round(100.0 * ok / total, 6) AS success, round(mean, 6) AS mean, CASE WHEN total >= 2 THEN round(v[j] + (pos - j) * (v[j + 1] - v[j]), 6) END AS p95 FROM p""")
def load_sessions(spark, sf):
    n = F.count("*")
    rest = M.exclusive_percentile(ev(spark, sf), ["user_id"], "value", 0.95, "_p")
    s = ev(spark, sf).groupBy("user_id").agg(
        n.alias("total"), F.count_if(F.col("event_type") != "error").alias("ok"), r6(M.ratio(F.count_if(F.col("event_type") != "error") * 100, n)).alias("success"),
        r6(F.avg("value")).alias("mean"))
    return s.join(rest, "user_id", "left").withColumn("p95", r6("_p")).drop("_p")


@q("load_rollup", """
WITH s AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, avg(value) AS mean FROM events GROUP BY 1)
SELECT count(*) AS sessions, sum(total)::BIGINT AS requests, sum(ok)::BIGINT AS ok, round(100.0 * sum(ok) / sum(total), 6) AS success, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS spread FROM s""")
def load_rollup(spark, sf):
    s = ev(spark, sf).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("good"), F.avg("value").alias("m"))
    return s.agg(F.count("*").alias("sessions"), F.sum("total").alias("requests"), F.sum("good").alias("ok"), r6(F.sum("good") * 100 / F.sum("total")).alias("success"), r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("spread"))


@q("latency_percentiles", """
WITH s AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, n, round(v[floor(n * 0.5)::INT + 1], 6) AS p50, round(v[floor(n * 0.95)::INT + 1], 6) AS p95, round(v[floor(n * 0.99)::INT + 1], 6) AS p99 FROM s""")
def latency_percentiles(spark, sf):
    shares = {f"p{int(p * 100)}": p for p in (0.5, 0.95, 0.99)}
    return M.floor_index_percentiles(ev(spark, sf), ["event_type"], "value", shares).select("event_type", "n", *[r6(x).alias(x) for x in shares])


@q("error_rates", """
SELECT user_id % 10 AS stage, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1""")
def error_rates(spark, sf):
    bad = F.count_if(F.col("event_type") == "error")
    return ev(spark, sf).groupBy((F.col("user_id") % 10).alias("stage")).agg(bad.alias("errors"), r6(M.ratio(bad, F.count("*"))).alias("rate"))


COUNTERS = """
WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type IN ('click', 'view')) AS h, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT day, sum(h) OVER (ORDER BY day) AS hits, sum(n) OVER (ORDER BY day) AS asked FROM d)"""


def counters(spark, sf) -> DataFrame:
    """Daily samples of two growing counters.  The window runs over one row a day."""
    d = ev(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count_if(F.col("event_type").isin("click", "view")).alias("h"), F.count("*").alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("day", F.sum("h").over(w).alias("hits"), F.sum("n").over(w).alias("asked"))


GRADES = [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.5, "D")]


@q("cache_summary", COUNTERS + """, x AS (SELECT (max_by(hits, day) - min_by(hits, day))::BIGINT AS hits, (max_by(asked, day) - min_by(asked, day))::BIGINT AS asked FROM c WHERE day > (SELECT max(day) FROM c) - INTERVAL 7 DAY)
SELECT hits, asked, round(hits / asked::DOUBLE, 6) AS hit_ratio, CASE WHEN hits / asked::DOUBLE >= .9 THEN 'A' WHEN hits / asked::DOUBLE >= .8 THEN 'B' WHEN hits / asked::DOUBLE >= .7 THEN 'C' WHEN hits / asked::DOUBLE >= .5 THEN 'D' ELSE 'F' END AS grade FROM x""")
def cache_summary(spark, sf):
    c = counters(spark, sf)
    c = c.join(F.broadcast(c.agg(F.max("day").alias("last"))), F.col("day") > F.col("last") - F.expr("INTERVAL 7 DAYS"))
    d = c.agg(*[(F.max_by(k, "day") - F.min_by(k, "day")).alias(k) for k in ("hits", "asked")])
    r = M.ratio(F.col("hits"), F.col("asked"))
    return d.select("hits", "asked", r6(r).alias("hit_ratio"), M.bands(r, GRADES, "F").alias("grade"))


@q("hit_ratio_trend", COUNTERS + """, r AS (SELECT day, (hits - lag(hits) OVER (ORDER BY day)) / nullif(asked - lag(asked) OVER (ORDER BY day), 0)::DOUBLE AS r FROM c),
k AS (SELECT r, row_number() OVER (ORDER BY day) AS a, row_number() OVER (ORDER BY day DESC) AS z FROM r WHERE r IS NOT NULL),
m AS (SELECT count(*) AS n, avg(r) AS mean, min(r) AS low, max(r) AS high, avg(r) FILTER (a <= 5) AS f, avg(r) FILTER (z <= 5) AS l FROM k)
SELECT n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN n < 5 THEN 'unknown' WHEN l > f + .05 THEN 'improving' WHEN l < f - .05 THEN 'declining' ELSE 'stable' END AS trend FROM m""")
def hit_ratio_trend(spark, sf):
    w = Window.orderBy("day")
    d = lambda k: F.col(k) - F.lag(k).over(w)
    r = counters(spark, sf).select("day", F.try_divide(d("hits").cast("double"), d("asked").cast("double")).alias("r")).where("r is not null")
    r = r.withColumn("a", F.row_number().over(w)).withColumn("z", F.row_number().over(Window.orderBy(F.desc("day"))))
    m = r.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.min("r").alias("low"), F.max("r").alias("high"), F.avg(F.when(F.col("a") <= 5, F.col("r"))).alias("f"), F.avg(F.when(F.col("z") <= 5, F.col("r"))).alias("l"))
    trend = F.when(F.col("n") < 5, "unknown").when(F.col("l") > F.col("f") + 0.05, "improving").when(F.col("l") < F.col("f") - 0.05, "declining").otherwise("stable")
    return m.select("n", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"), trend.alias("trend"))


@q("repair_stats", """
SELECT count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS repaired, round(count(*) FILTER (event_type = 'purchase') / greatest(1, count(*))::DOUBLE, 6) AS success, max(ts) AS last_at
FROM events WHERE event_type IN ('purchase', 'error') AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def repair_stats(spark, sf):
    e = ev(spark, sf)
    d = e.join(as_of(e), F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")).where(F.col("event_type").isin("purchase", "error"))
    good = F.count_if(F.col("event_type") == "purchase")
    return d.agg(F.count("*").alias("attempts"), good.alias("repaired"), r6(good / F.greatest(F.lit(1), F.count("*"))).alias("success"), F.max("ts").alias("last_at"))


RULES = [("success_rate", "gte", 95.0, 99.0), ("mean_value", "lte", 60.0, 20.0), ("error_share", "lte", 30.0, 10.0), ("users", "gte", 15.0, 20.0)]
RULE_SQL = ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in RULES)
VERDICT_SQL = "CASE WHEN op = 'gte' THEN CASE WHEN value >= target THEN 'PASS' WHEN value >= minimum THEN 'WARN' ELSE 'FAIL' END ELSE CASE WHEN value <= target THEN 'PASS' WHEN value <= minimum THEN 'WARN' ELSE 'FAIL' END END"
METRIC_SQL = f"""
WITH m AS (SELECT 100.0 * avg((event_type <> 'error')::INT) AS a, avg(value) AS b, 100.0 * avg((event_type = 'error')::INT) AS c, count(DISTINCT user_id)::DOUBLE AS d FROM events),
s(metric, value) AS (SELECT 'success_rate', a FROM m UNION ALL SELECT 'mean_value', b FROM m UNION ALL SELECT 'error_share', c FROM m UNION ALL SELECT 'users', d FROM m),
r(metric, op, minimum, target) AS (VALUES {RULE_SQL}), v AS (SELECT s.metric, round(value, 6) AS value, {VERDICT_SQL} AS verdict FROM s JOIN r ON s.metric = r.metric)"""


def verdicts(spark, sf) -> DataFrame:
    """Metrics stacked to rows, joined to their rules."""
    bad = (F.col("event_type") == "error").cast("int")
    m = ev(spark, sf).agg((F.avg(1 - bad) * 100).alias("success_rate"), F.avg("value").alias("mean_value"), (F.avg(bad) * 100).alias("error_share"), F.count_distinct("user_id").cast("double").alias("users"))
    s = m.unpivot([], [r[0] for r in RULES], "metric", "value")
    rules = F.broadcast(spark.createDataFrame(RULES, "metric string, op string, minimum double, target double"))
    v, t, lo = F.col("value"), F.col("target"), F.col("minimum")
    up = F.when(v >= t, "PASS").when(v >= lo, "WARN").otherwise("FAIL")
    down = F.when(v <= t, "PASS").when(v <= lo, "WARN").otherwise("FAIL")
    return s.join(rules, "metric").select("metric", r6(v).alias("value"), F.when(F.col("op") == "gte", up).otherwise(down).alias("verdict"))


Q["rule_verdicts"] = (verdicts, METRIC_SQL + " SELECT * FROM v")


@q("performance_grade", METRIC_SQL + """, g AS (SELECT count(*) FILTER (verdict = 'FAIL') AS fails, count(*) FILTER (verdict = 'WARN') AS warns, count(*) FILTER (verdict = 'PASS') AS passes FROM v)
SELECT *, CASE WHEN fails = 0 AND warns = 0 THEN 'A' WHEN fails = 0 THEN 'B' WHEN fails <= 1 THEN 'C' WHEN fails <= 2 THEN 'D' ELSE 'F' END AS grade FROM g""")
def performance_grade(spark, sf):
    g = verdicts(spark, sf).agg(*[F.count_if(F.col("verdict") == k.upper()).alias(n) for k, n in (("fail", "fails"), ("warn", "warns"), ("pass", "passes"))])
    grade = F.when((F.col("fails") == 0) & (F.col("warns") == 0), "A").when(F.col("fails") == 0, "B").when(F.col("fails") <= 1, "C").when(F.col("fails") <= 2, "D").otherwise("F")
    return g.withColumn("grade", grade)


@q("trailing_sums", """
SELECT count(*) FILTER (event_type = 'purchase') AS successful, count(*) FILTER (event_type = 'error') AS failed, round(coalesce(sum(value), 0), 6) AS amount FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 HOUR""")
def trailing_sums(spark, sf):
    e = ev(spark, sf)
    d = e.join(as_of(e), F.col("ts") > F.col("now") - F.expr("INTERVAL 5 HOURS"))
    return d.agg(F.count_if(F.col("event_type") == "purchase").alias("successful"), F.count_if(F.col("event_type") == "error").alias("failed"), r6(F.coalesce(F.sum("value"), F.lit(0.0))).alias("amount"))


@q("event_volume", """
SELECT count(*) AS total, count(*) FILTER (ts > now_ - INTERVAL 1 MINUTE) AS last_minute, count(*) FILTER (ts > now_ - INTERVAL 1 MINUTE) > 5000 AS alarm FROM events, (SELECT max(ts) AS now_ FROM events)""")
def event_volume(spark, sf):
    e = ev(spark, sf)
    late = F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 MINUTE"))
    return e.crossJoin(as_of(e)).agg(F.count("*").alias("total"), late.alias("last_minute"), (late > 5000).alias("alarm"))


TTL = """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events), a AS (
SELECT user_id, count(*) AS accesses, avg((event_type IN ('click', 'view'))::INT) AS hit, avg(value) AS ttl, count(*) / 7.0 AS per_day FROM k WHERE r <= 1000 GROUP BY 1),
t AS (SELECT user_id, accesses, round(hit, 6) AS hit_ratio, round(ttl, 6) AS mean_ttl, round(per_day, 6) AS per_day, CASE WHEN per_day > 10 THEN 'extend' WHEN per_day > 1 THEN 'keep' ELSE 'shorten' END AS advice FROM a)"""


def ttl(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    d = ev(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 1000").groupBy("user_id").agg(
        F.count("*").alias("accesses"), r6(F.avg(F.col("event_type").isin("click", "view").cast("int"))).alias("hit_ratio"), r6(F.avg("value")).alias("mean_ttl"), (F.count("*") / 7.0).alias("d"))
    advice = F.when(F.col("d") > 10, "extend").when(F.col("d") > 1, "keep").otherwise("shorten")
    return d.select("user_id", "accesses", "hit_ratio", "mean_ttl", r6("d").alias("per_day"), advice.alias("advice"))


Q["ttl_patterns"] = (ttl, TTL + " SELECT * FROM t")


@q("frequent_keys", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 100")
def frequent_keys(spark, sf):
    return ev(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(100)


@q("ttl_policy", TTL + """, f AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 100)
SELECT count(*) AS keys, count(*) FILTER (advice = 'extend') AS extend, count(*) FILTER (advice = 'keep') AS keep, count(*) FILTER (advice = 'shorten') AS shorten FROM t JOIN f USING (user_id)""")
def ttl_policy(spark, sf):
    d = ttl(spark, sf).join(F.broadcast(frequent_keys(spark, sf).select("user_id")), "user_id")
    return d.agg(F.count("*").alias("keys"), *[F.count_if(F.col("advice") == k).alias(k) for k in ("extend", "keep", "shorten")])


@q("health_rollup", """
WITH s AS (SELECT user_id, avg((event_type <> 'error')::INT) >= 0.75 AS ok FROM events GROUP BY 1)
SELECT count(*) AS services, count(*) FILTER (ok) AS healthy, round(100.0 * count(*) FILTER (ok) / count(*), 1) AS percentage,
CASE WHEN count(*) FILTER (ok) = count(*) THEN 'healthy' WHEN 100.0 * count(*) FILTER (ok) / count(*) >= 70 THEN 'degraded' ELSE 'unhealthy' END AS status FROM s""")
def health_rollup(spark, sf):
    s = ev(spark, sf).groupBy("user_id").agg((F.avg((F.col("event_type") != "error").cast("int")) >= 0.75).alias("ok"))
    n, k = F.count("*"), F.count_if("ok")
    return s.agg(n.alias("services"), k.alias("healthy"), F.round(k * 100 / n, 1).alias("percentage"), F.when(k == n, "healthy").when(k * 100 / n >= 70, "degraded").otherwise("unhealthy").alias("status"))


@q("pool_summary", """
WITH h AS (SELECT user_id % 5 AS pool, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT pool, max(n) AS peak, avg(n) AS mean FROM h GROUP BY 1), s AS (SELECT user_id % 5 AS pool, count(*) FILTER (event_type <> 'error') AS ok, count(*) AS n, avg(value) AS hold FROM events GROUP BY 1)
SELECT p.pool, peak, round(mean / peak, 6) AS utilisation, round(100.0 * ok / n, 6) AS success, round(hold, 6) AS mean_hold FROM p JOIN s ON p.pool = s.pool""")
def pool_summary(spark, sf):
    e = ev(spark, sf).withColumn("pool", F.col("user_id") % 5)
    h = e.groupBy("pool", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("good"), F.sum("value").alias("v"))
    return h.groupBy("pool").agg(F.max("n").alias("peak"), r6(F.avg("n") / F.max("n")).alias("utilisation"), r6(M.ratio(F.sum("good") * 100, F.sum("n"), 100.0)).alias("success"), r6(F.sum("v") / F.sum("n")).alias("mean_hold"))


@q("compliance_score", """
WITH s AS (SELECT event_type, 100.0 * avg((value < 50)::INT) AS score FROM events GROUP BY 1), w(event_type, weight) AS (VALUES ('click', .4), ('view', .3), ('purchase', .2), ('missing', .1)),
t AS (SELECT sum(weight * coalesce(score, 0)) AS total FROM w LEFT JOIN s USING (event_type))
SELECT round(total, 6) AS total, CASE WHEN total >= 90 THEN 'compliant' WHEN total >= 70 THEN 'warning' ELSE 'critical' END AS status FROM t""")
def compliance_score(spark, sf):
    s = ev(spark, sf).groupBy("event_type").agg((F.avg((F.col("value") < 50).cast("int")) * 100).alias("score"))
    w = spark.createDataFrame([("click", 0.4), ("view", 0.3), ("purchase", 0.2), ("missing", 0.1)], "event_type string, weight double")
    t = w.join(s, "event_type", "left").agg(F.sum(F.col("weight") * F.coalesce("score", F.lit(0.0))).alias("t"))
    return t.select(r6("t").alias("total"), M.bands(F.col("t"), [(90, "compliant"), (70, "warning")], "critical").alias("status"))


@q("queue_stats", """
WITH d AS (SELECT user_id % 20 AS queue, count(*) AS depth, count(DISTINCT user_id) AS workers FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT queue, depth, round(depth / 1000.0, 6) AS utilisation, depth * 30 // greatest(1, least(depth // 100, 10)) AS delay,
CASE WHEN depth >= 900 THEN 'critical' WHEN depth >= 800 THEN 'high' WHEN depth >= 150 THEN 'medium' ELSE 'low' END AS severity,
round(0.7 * greatest(0, 1 - depth / 1000.0) + 0.3 * (workers > 0)::INT, 3) AS health FROM d""")
def queue_stats(spark, sf):
    d = scoped(ev(spark, sf), event_type="view").groupBy((F.col("user_id") % 20).alias("queue")).agg(F.count("*").alias("depth"), F.count_distinct("user_id").alias("workers"))
    n = F.col("depth")
    return d.select("queue", "depth", r6(n / 1000.0).alias("utilisation"), F.floor(n * 30 / F.greatest(F.lit(1), F.least(F.floor(n / 100), F.lit(10)))).alias("delay"),
                    M.bands(n, [(900, "critical"), (800, "high"), (150, "medium")], "low").alias("severity"),
                    F.round(0.7 * F.greatest(F.lit(0.0), 1 - n / 1000.0) + 0.3 * (F.col("workers") > 0).cast("int"), 3).alias("health"))


HOURLY = "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2)"


def hourly(spark, sf) -> DataFrame:
    return ev(spark, sf).groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))


@q("alert_islands", HOURLY + """, f AS (SELECT *, n >= 4 AS fire, lag(n >= 4, 1, false) OVER (PARTITION BY event_type ORDER BY hour) AS was FROM h),
g AS (SELECT *, sum((fire AND NOT was)::INT) OVER (PARTITION BY event_type ORDER BY hour) AS run FROM f)
SELECT event_type, run::BIGINT AS run, min(hour) AS started, max(hour) AS ended, count(*) AS n FROM g WHERE fire GROUP BY 1, 2""")
def alert_islands(spark, sf):
    return M.islands(hourly(spark, sf), ["event_type"], "hour", F.col("n") >= 4)


@q("alert_lifecycle", HOURLY + """, f AS (SELECT *, n >= 4 AS fire, coalesce(lag(n >= 4) OVER (PARTITION BY event_type ORDER BY hour), false) AS was FROM h)
SELECT event_type, hour, CASE WHEN fire AND NOT was THEN 'new' WHEN fire THEN 'continuing' ELSE 'resolved' END AS state FROM f WHERE fire OR was""")
def alert_lifecycle(spark, sf):
    fire = F.col("n") >= 4
    d = hourly(spark, sf).withColumn("was", F.coalesce(F.lag(fire).over(Window.partitionBy("event_type").orderBy("hour")), F.lit(False)))
    return d.where(fire | F.col("was")).select("event_type", "hour", F.when(fire & ~F.col("was"), "new").when(fire, "continuing").otherwise("resolved").alias("state"))


@q("rate_alerts", """
WITH m AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1),
w AS (SELECT hour, sum(ok) OVER r / (sum(n) OVER r)::DOUBLE AS rate FROM m WINDOW r AS (ORDER BY hour RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW)),
f AS (SELECT *, rate < .8 AS fire, coalesce(lag(rate < .8) OVER (ORDER BY hour), false) AS was FROM w), g AS (SELECT *, sum((fire AND NOT was)::INT) OVER (ORDER BY hour) AS run FROM f)
SELECT run::BIGINT AS run, min(hour) AS started, max(hour) AS ended, count(*) AS n FROM g WHERE fire GROUP BY 1 HAVING count(*) >= 2""")
def rate_alerts(spark, sf):
    m = ev(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok")).withColumn("all", F.lit(1))
    w = Window.partitionBy("all").orderBy(M.micros("hour")).rangeBetween(-5 * 3600 * 1_000_000, 0)
    m = m.withColumn("rate", F.sum("ok").over(w) / F.sum("n").over(w))
    return M.islands(m, ["all"], "hour", F.col("rate") < 0.8).where("n >= 2").drop("all")


@q("sliding_window_count", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS in_window,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM events""")
def sliding_window_count(spark, sf):
    w = Window.partitionBy("user_id").orderBy(M.micros("ts")).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return ev(spark, sf).select("event_id", "user_id", F.count("*").over(w).alias("in_window")).withColumn("allowed", F.col("in_window") <= 2)


@q("fixed_rate_limit", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS nth,
row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def fixed_rate_limit(spark, sf):
    w = Window.partitionBy("user_id", F.window("ts", "1 hour")).orderBy("ts", "event_id")
    return ev(spark, sf).select("event_id", "user_id", F.row_number().over(w).cast("long").alias("nth")).withColumn("allowed", F.col("nth") <= 1)


SESSION = """
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum((gap IS NULL OR gap >= INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)"""


@q("debounce_sessions", SESSION + """
SELECT user_id, session, min(ts) AS started, count(*) AS n, CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE max_by(event_type, (ts, event_id)) END AS outcome FROM s GROUP BY 1, 2""")
def debounce_sessions(spark, sf):
    d = M.sessions(ev(spark, sf), ["user_id"], "ts", 6 * 3600).groupBy("user_id", "session")
    outcome = F.when(F.bool_or(F.col("event_type") == "error"), "error").otherwise(F.max_by("event_type", F.struct("ts", "event_id")))
    return d.agg(F.min("ts").alias("started"), F.count("*").alias("n"), outcome.alias("outcome"))


@q("event_storms", SESSION + ", b AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2) SELECT count(*) AS batches, count(*) FILTER (n > 3) AS storms FROM b")
def event_storms(spark, sf):
    b = debounce_sessions(spark, sf)
    return b.agg(F.count("*").alias("batches"), F.count_if(F.col("n") > 3).alias("storms"))


@q("session_lifecycle", SESSION + "SELECT user_id, count(DISTINCT session) AS sessions, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS expired FROM s GROUP BY 1")
def session_lifecycle(spark, sf):
    e = ev(spark, sf)
    d = M.sessions(e, ["user_id"], "ts", 6 * 3600).groupBy("user_id").agg(F.max("session").alias("sessions"), F.max("ts").alias("last_seen"))
    return d.crossJoin(as_of(e)).select("user_id", "sessions", "last_seen", (F.col("last_seen") < F.col("now") - F.expr("INTERVAL 6 HOURS")).alias("expired"))


@q("dedup_hash", """
WITH h AS (SELECT event_id, user_id, md5(event_type) AS h, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, user_id, h FROM h WHERE p IS NULL OR p <> h""")
def dedup_hash(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = ev(spark, sf).withColumn("h", F.md5("event_type")).withColumn("p", F.lag("h").over(w))
    return d.where("p is null or p <> h").select("event_id", "user_id", "h")


@q("metric_sampling", "SELECT date_trunc('hour', ts) AS minute, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2")
def metric_sampling(spark, sf):
    e = ev(spark, sf)
    d = e.join(as_of(e), F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))
    return d.groupBy(F.window("ts", "1 hour").start.alias("minute"), "event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@q("trailing_histogram", """
SELECT event_id, count(*) OVER w AS n, round(max(value) OVER w, 6) AS high FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def trailing_histogram(spark, sf):
    w = Window.partitionBy("user_id").orderBy(M.micros("ts")).rangeBetween(-3600 * 1_000_000, 0)
    return scoped(ev(spark, sf), event_type="purchase").select("event_id", F.count("*").over(w).alias("n"), r6(F.max("value").over(w)).alias("high"))


@q("connection_quota", """
WITH d AS (SELECT event_id, user_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS open FROM events)
SELECT *, open > 10 AS over_quota FROM d""")
def connection_quota(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return ev(spark, sf).select("event_id", "user_id", F.sum(step).over(w).alias("open")).withColumn("over_quota", F.col("open") > 10)


@q("asof_throughput", """
WITH h AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events),
m AS (SELECT user_id, max(ts) AS now_ FROM events GROUP BY 1)
SELECT h.user_id, max(c)::BIGINT AS now_count, coalesce(max(c) FILTER (ts <= now_ - INTERVAL 1 DAY), 0)::BIGINT AS then_count, (max(c) - coalesce(max(c) FILTER (ts <= now_ - INTERVAL 1 DAY), 0))::BIGINT AS per_day FROM h JOIN m ON h.user_id = m.user_id GROUP BY 1""")
def asof_throughput(spark, sf):
    e = ev(spark, sf).select("user_id", "ts")
    w = Window.partitionBy("user_id")
    d = e.withColumn("now", F.max("ts").over(w))
    then = F.count_if(F.col("ts") <= F.col("now") - F.expr("INTERVAL 1 DAY"))
    return d.groupBy("user_id").agg(F.count("*").alias("now_count"), then.alias("then_count"), (F.count("*") - then).alias("per_day"))


SAMPLES = """
WITH h AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) + 3600000000 AS at_us, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2),
e AS (SELECT event_id, event_type, epoch_us(ts) - 60000000 AS us FROM events)"""


@q("asof_samples", SAMPLES + " SELECT event_id, e.event_type, h.at_us, h.n, h.mean FROM e ASOF JOIN h ON e.event_type = h.event_type AND e.us >= h.at_us")
def asof_samples(spark, sf):
    """Each event with the latest hourly sample of its type that was complete a minute before it."""
    e = ev(spark, sf).withColumn("us", M.micros("ts"))
    hour = F.floor(F.col("us") / 3_600_000_000).cast("long") * 3_600_000_000 + 3_600_000_000
    samples = e.groupBy("event_type", hour.alias("sampled")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).withColumn("at_us", F.col("sampled"))
    left = e.select("event_id", "event_type", (F.col("us") - 60_000_000).alias("us"))
    return I.as_of(left, samples, ["event_type"], "us", "sampled", ["at_us", "n", "mean"], 86_400_000_000).drop("us").where("at_us is not null")


@q("usage_percent", """
WITH d AS (SELECT event_id, user_id, value - lag(value) OVER w AS dv, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CASE WHEN dv > 0 AND dt > 0 THEN round(dv / dt * 1e6 * 100, 6) ELSE 0.0 END AS percent FROM d WHERE dt IS NOT NULL""")
def usage_percent(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = ev(spark, sf).select("event_id", "user_id", (F.col("value") - F.lag("value").over(w)).alias("dv"), (M.micros("ts") - M.micros(F.lag("ts").over(w))).alias("dt"))
    return d.where("dt is not null").select("event_id", "user_id", F.when((F.col("dv") > 0) & (F.col("dt") > 0), r6(F.col("dv") / F.col("dt") * 1e6 * 100)).otherwise(0.0).alias("percent"))


@q("running_totals", """
WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)
SELECT day, (sum(n) OVER w)::BIGINT AS total, round(sum(v) OVER w / sum(n) OVER w, 4) AS running_mean FROM d WINDOW w AS (ORDER BY day)""")
def running_totals(spark, sf):
    d = ev(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("day", F.sum("n").over(w).alias("total"), F.round(F.sum("v").over(w) / F.sum("n").over(w), 4).alias("running_mean"))


@q("row_validation", """
SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL OR value < 0) AS bad_range, count(*) FILTER (NOT regexp_matches(props, '^\\{"k": [0-9]+\\}$')) AS bad_format, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'error')) AS bad_enum FROM events GROUP BY 1""")
def row_validation(spark, sf):
    return ev(spark, sf).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad_range"),
        F.count_if(~F.col("props").rlike(r'^\{"k": [0-9]+\}$')).alias("bad_format"), F.count_if(~F.col("event_type").isin("click", "view", "purchase", "error")).alias("bad_enum"))


@q("json_fields", "SELECT (props->>'$.k')::INT % 10 AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def json_fields(spark, sf):
    return ev(spark, sf).groupBy((F.from_json("props", "k int")["k"] % 10).alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@q("event_age_days", "SELECT floor((epoch_us(now_) - epoch_us(ts)) / 86400000000)::BIGINT AS days, count(*) AS n FROM events, (SELECT max(ts) AS now_ FROM events) GROUP BY 1")
def event_age_days(spark, sf):
    e = ev(spark, sf)
    return e.crossJoin(as_of(e)).groupBy(F.floor((M.micros("now") - M.micros("ts")) / 86400000000).alias("days")).agg(F.count("*").alias("n"))


@q("idempotent_append", """
WITH k AS (SELECT *, md5(user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d')) AS idem FROM events)
SELECT idem, min(event_id) AS event_id FROM k GROUP BY 1""")
def idempotent_append(spark, sf):
    key = F.md5(F.concat_ws(":", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")))
    return ev(spark, sf).groupBy(key.alias("idem")).agg(F.min("event_id").alias("event_id"))


@q("metric_exposition", """
SELECT 'events_total{type=' || event_type || ',user_group=' || (user_id % 2) || '} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 2""")
def metric_exposition(spark, sf):
    d = ev(spark, sf).groupBy("event_type", (F.col("user_id") % 2).alias("g")).agg(F.count("*").alias("n"))
    return d.select(F.format_string("events_total{type=%s,user_group=%d} %d", "event_type", "g", "n").alias("line"))
