"""Knowledge-graph, consistency and catalog queries.

Nodes are parts, suppliers, customers and nations; parts that follow each other in an order import each other (IMPORTS), suppliers supply parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V
from tessera.operators import graph as G
from tessera.operators import intervals as I
from tessera.operators import retrieval as R
from tessera.operators import sync as S
from tessera.sources.shared import kept, shuffles_end, stored
from tessera.sources.tables import table

Q: dict = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


E_SQL = """
WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
imp AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber WHERE a.l_partkey <> b.l_partkey),
sup AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM li)"""


def lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def imports(spark, sf) -> DataFrame:
    """Edges between parts, in order of their source; a self-join of all lines, so it is written once and kept for the application."""
    with shuffles_end(spark):
        folder = kept(table(spark, sf, "lineitem"), "imports", lambda at: found_imports(spark, sf).sortWithinPartitions("src").write.parquet(at))
    return spark.read.schema("src long, dst long").parquet(folder)


def found_imports(spark, sf) -> DataFrame:
    a = lines(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("la"), F.col("l_partkey").alias("src"))
    b = lines(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("lb"), F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("lb > la and src <> dst").select("src", "dst").repartition("src").distinct()  # one shuffle: edges of a source are together


def supplies(spark, sf) -> DataFrame:
    return lines(spark, sf).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


#: The starts of a traversal are its query set, a parameter: the parts divisible by this number, so they grow with the parts.  Exact reach of three hops has a row
#: for each start and nearly every part, so its starts are fewer; ``impact_sketches`` sizes the neighbourhoods of all parts.
SEEDS, FAR_SEEDS = 100, 1000


def starts(spark, sf, every: int = FAR_SEEDS) -> DataFrame:
    return table(spark, sf, "part", "p_partkey").where(F.col("p_partkey") % every == 0).select(F.col("p_partkey").alias("node"))


@q("graph_neighbors", E_SQL + " SELECT 'imports' AS direction, dst AS node FROM imp WHERE src = 7 UNION ALL SELECT 'imported_by', src FROM imp WHERE dst = 7")
def graph_neighbors(spark, sf):
    return G.neighbours(imports(spark, sf), 7, "both")


M_SQL = E_SQL.replace("imp AS (", "imp AS MATERIALIZED (")
REACH = M_SQL + f""", s AS (SELECT p_partkey AS start FROM part WHERE p_partkey % {FAR_SEEDS} = 0), h1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN imp ON src = start),
h2 AS MATERIALIZED (SELECT DISTINCT start, dst AS node FROM h1 JOIN imp ON src = node), h3 AS MATERIALIZED (SELECT DISTINCT start, dst AS node FROM h2 JOIN imp ON src = node),
r AS MATERIALIZED (SELECT start, node, min(hop)::INT AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY 1, 2)"""


@q("graph_reach3", REACH + " SELECT start, node, hop FROM r")
def graph_reach3(spark, sf):
    return G.reach(imports(spark, sf), starts(spark, sf), 3, ready=True)


@q("reach_both_ways", E_SQL + """, u AS (SELECT src, dst FROM imp UNION SELECT dst, src FROM imp), a AS (SELECT DISTINCT dst AS node FROM u WHERE src = 3), b AS (SELECT DISTINCT u.dst AS node FROM a JOIN u ON u.src = a.node WHERE u.dst <> 3)
SELECT node, min(hop)::INT AS hop FROM (SELECT node, 1 AS hop FROM a UNION ALL SELECT node, 2 FROM b) GROUP BY 1""")
def reach_both_ways(spark, sf):
    """Undirected; the start itself is left out."""
    s = table(spark, sf, "part", F.col("p_partkey").alias("node")).where("node = 3")
    return G.reach(imports(spark, sf), s, 2, direction="both").where("node <> start").select("node", "hop")


IMPACT = M_SQL + f""", s AS (SELECT p_partkey AS start FROM part WHERE p_partkey % {FAR_SEEDS} = 0), h1 AS (SELECT DISTINCT start, src AS node FROM s JOIN imp ON dst = start),
h2 AS (SELECT DISTINCT start, src AS node FROM h1 JOIN imp ON dst = node), h3 AS (SELECT DISTINCT start, src AS node FROM h2 JOIN imp ON dst = node),
d AS (SELECT start, count(*) AS direct FROM h1 GROUP BY 1), t AS (SELECT start, count(*) AS transitive FROM (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3) GROUP BY 1),
i AS (SELECT s.start AS node, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive FROM s LEFT JOIN d ON s.start = d.start LEFT JOIN t ON s.start = t.start)"""
RISK = "CASE WHEN {0} = 0 THEN 'low' WHEN {0} < 5 THEN 'medium' WHEN {0} < 20 THEN 'high' ELSE 'critical' END"


@q("impact_analysis", IMPACT + f" SELECT *, direct + transitive AS total_affected, {RISK.format('(direct + transitive)')} AS risk, {RISK.format('transitive')} AS distinct_risk FROM i")
def impact_analysis(spark, sf):
    """``total_affected`` counts direct importers twice, ``distinct_risk`` once."""
    r = G.reach_counts(imports(spark, sf), starts(spark, sf), 3, direction="in", ready=True).withColumnRenamed("start", "node")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    i = starts(spark, sf).join(r, "node", "left").select("node", z("direct"), z("transitive"))
    total = F.col("direct") + F.col("transitive")
    return i.withColumn("total_affected", total).withColumn("risk", G.risk(total)).withColumn("distinct_risk", G.risk(F.col("transitive")))


@q("impact_advice", IMPACT + " SELECT node, list_filter([CASE WHEN transitive >= 20 THEN 'stage the rollout' END, CASE WHEN direct > 3 THEN 'tell direct dependents' END, CASE WHEN transitive = 0 THEN 'safe to change' END], lambda x: x IS NOT NULL) AS advice FROM i")
def impact_advice(spark, sf):
    a = F.array(F.when(F.col("transitive") >= 20, "stage the rollout"), F.when(F.col("direct") > 3, "tell direct dependents"), F.when(F.col("transitive") == 0, "safe to change"))
    return impact_analysis(spark, sf).select("node", F.array_compact(a).alias("advice"))


@q("impact_sketches")
def impact_sketches(spark, sf):
    """About how many parts a change of each part reaches within three hops against its imports; all parts at once."""
    r = G.reach_sizes(imports(spark, sf), 3, direction="in", ready=True)
    return table(spark, sf, "part", F.col("p_partkey").alias("node")).join(r, "node", "left").select("node", F.coalesce("reached", F.lit(0)).alias("affected"))


EXACT = IMPACT.replace(f"p_partkey % {FAR_SEEDS} = 0", f"p_partkey % {SEEDS} = 0")


@q("impact_sketch_error", EXACT + " SELECT node, transitive AS exact, true AS within_bound FROM i")
def impact_sketch_error(spark, sf):
    """The exact number beside the sketch's, for parts divisible by ``SEEDS``: within four standard errors."""
    s = starts(spark, sf, SEEDS)
    exact = G.reach_counts(imports(spark, sf), s, 3, direction="in", ready=True).select(F.col("start").alias("node"), F.col("transitive").alias("exact"))
    d = s.join(exact, "node", "left").join(impact_sketches(spark, sf), "node").select("node", F.coalesce("exact", F.lit(0)).alias("exact"), "affected")
    return d.select("node", "exact", (F.abs(F.col("affected") - F.col("exact")) <= 4 * G.SKETCH_ERROR * F.col("exact")).alias("within_bound"))


@q("subgraph", REACH.replace(f"p_partkey % {FAR_SEEDS} = 0", f"p_partkey % {SEEDS} = 0") + ", n AS MATERIALIZED (SELECT node FROM r WHERE hop <= 1 UNION SELECT start FROM s) SELECT src, dst FROM imp WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def subgraph(spark, sf):
    s = starts(spark, sf, SEEDS)
    e = imports(spark, sf)
    nodes = G.reach(e, s, 1, ready=True).select("node").unionByName(s).distinct()
    return G.induced(e, nodes)


#: Typed edges: parts import parts, suppliers (as negative numbers) supply parts.
TYPED = M_SQL + ", e AS MATERIALIZED (SELECT 'IMPORTS' AS rel, src, dst FROM imp UNION ALL SELECT 'SUPPLIES', -src, dst FROM sup)"


def typed_edges(spark, sf) -> DataFrame:
    i = imports(spark, sf).select(F.lit("IMPORTS").alias("rel"), "src", "dst")
    return i.unionByName(supplies(spark, sf).select(F.lit("SUPPLIES").alias("rel"), (-F.col("src")).alias("src"), "dst"))


@q("typed_subgraph", TYPED + f""", s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % {SEEDS} = 0), u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
n AS MATERIALIZED (SELECT node FROM s UNION SELECT u.dst FROM s JOIN u ON u.src = s.node) SELECT rel, src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def typed_subgraph(spark, sf):
    """Nodes one step either way from the starts over both types of edges, and the edges among them."""
    s, e = starts(spark, sf, SEEDS), stored(typed_edges(spark, sf), "edges")
    nodes = G.reach(e, s, 1, ["IMPORTS", "SUPPLIES"], "both").select("node").unionByName(s).distinct()
    return G.induced(e, nodes).select("rel", "src", "dst")


@q("typed_reach", TYPED + f""", s AS (SELECT p_partkey AS start FROM part WHERE p_partkey % {SEEDS} = 0), u AS MATERIALIZED (SELECT src, dst FROM e WHERE rel = 'SUPPLIES' UNION SELECT dst, src FROM e WHERE rel = 'SUPPLIES'),
a AS MATERIALIZED (SELECT DISTINCT start, dst AS node FROM s JOIN u ON src = start), b AS (SELECT DISTINCT start, dst AS node FROM a JOIN u ON src = node)
SELECT start, node, min(hop)::INT AS hop FROM (SELECT *, 1 AS hop FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY 1, 2""")
def typed_reach(spark, sf):
    """Parts that share a supplier with a start, over one type of edges either way."""
    return G.reach(typed_edges(spark, sf), starts(spark, sf, SEEDS), 2, ["SUPPLIES"], "both")


#: Edges to show of each side of a node: a report, so the limits are the feature.
SIDES = (("callee", "src", 50), ("caller", "dst", 50), ("either", None, 100))


@q("callers_callees", E_SQL + """, n AS (SELECT src, dst, a.p_name AS caller, b.p_name AS callee FROM imp JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey)
(SELECT 'callee' AS side, caller, callee FROM n WHERE src = 7 ORDER BY caller, callee LIMIT 50) UNION ALL (SELECT 'caller', caller, callee FROM n WHERE dst = 7 ORDER BY caller, callee LIMIT 50)
UNION ALL (SELECT 'either', caller, callee FROM n WHERE src = 7 OR dst = 7 ORDER BY caller, callee LIMIT 100)""")
def callers_callees(spark, sf, node: int = 7):
    """The edges out of, into and on either side of one node, with the names of both ends."""
    e = imports(spark, sf).where((F.col("src") == node) | (F.col("dst") == node))
    name = lambda k, n: table(spark, sf, "part", F.col("p_partkey").alias(k), F.col("p_name").alias(n))
    e, out = e.join(name("src", "caller"), "src").join(name("dst", "callee"), "dst"), None
    for side, end, n in SIDES:
        one = e.where(F.lit(True) if end is None else F.col(end) == node).orderBy("caller", "callee").limit(n).select(F.lit(side).alias("side"), "caller", "callee")
        out = one if out is None else out.unionByName(one)
    return out


#: Every part over the edges of all lines, one grouped count a branch.
CTX = E_SQL + """, ci AS (SELECT dst AS node, count(*) AS imported_by FROM imp GROUP BY 1), co AS (SELECT src AS node, count(*) AS imports FROM imp GROUP BY 1), cs AS (SELECT dst AS node, count(*) AS suppliers FROM sup GROUP BY 1),
c AS (SELECT p_partkey AS node, coalesce(imported_by, 0) AS imported_by, coalesce(imports, 0) AS imports, coalesce(suppliers, 0) AS suppliers FROM part LEFT JOIN ci ON ci.node = p_partkey LEFT JOIN co ON co.node = p_partkey LEFT JOIN cs ON cs.node = p_partkey)"""


def contexts(spark, sf) -> DataFrame:
    nodes = table(spark, sf, "part", F.col("p_partkey").alias("node"))
    e = imports(spark, sf)
    c = G.context(nodes, G.counts_by(e, "dst", "imported_by"), G.counts_by(e, "src", "imports"), G.counts_by(supplies(spark, sf), "dst", "suppliers"))
    return c.na.fill(0)


Q["graph_context"] = (contexts, CTX + " SELECT * FROM c")


@q("context_chain", E_SQL + """, nxt AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
f AS (SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS functions, count(DISTINCT l_suppkey) AS classes FROM li GROUP BY 1), k AS (SELECT src AS node, count(*) AS calls FROM nxt GROUP BY 1), r AS (SELECT dst AS node, count(*) AS callers FROM nxt GROUP BY 1),
o AS (SELECT src AS node, count(*) AS imports FROM imp GROUP BY 1), i AS (SELECT dst AS node, count(*) AS importers FROM imp GROUP BY 1), b AS (SELECT p_brand, count(*) - 1 AS siblings FROM part GROUP BY 1)
SELECT p_partkey AS node, coalesce(functions, 0) AS functions, coalesce(classes, 0) AS classes, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(imports, 0) AS imports, coalesce(importers, 0) AS importers, coalesce(siblings, 0) AS siblings
FROM part p LEFT JOIN f ON f.node = p_partkey LEFT JOIN k ON k.node = p_partkey LEFT JOIN r ON r.node = p_partkey LEFT JOIN o ON o.node = p_partkey LEFT JOIN i ON i.node = p_partkey LEFT JOIN b ON b.p_brand = p.p_brand""")
def context_chain(spark, sf):
    """The seven branches of a node's context; a node with nothing on a branch stays with 0.

    Orders stand for functions, suppliers for classes, the next line of an order for a call, parts of the brand for siblings.
    """
    part = table(spark, sf, "part", F.col("p_partkey").alias("node"), "p_brand")
    a = lines(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    b = lines(spark, sf).select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    calls, e = a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct(), imports(spark, sf)
    own = lines(spark, sf).groupBy(F.col("l_partkey").alias("node")).agg(F.count_distinct("l_orderkey").alias("functions"), F.count_distinct("l_suppkey").alias("classes"))
    branches = [own, *(G.counts_by(d, k, n) for d, k, n in ((calls, "src", "calls"), (calls, "dst", "callers"), (e, "src", "imports"), (e, "dst", "importers")))]
    brand = part.groupBy("p_brand").agg((F.count("*") - 1).alias("siblings"))
    return G.context(part, *branches).join(brand, "p_brand", "left").drop("p_brand").na.fill(0)


@q("context_lists", E_SQL + " SELECT p_partkey AS node, list_sort(list_distinct(list(src)))[1:5] AS first_importers, p_name FROM part JOIN imp ON dst = p_partkey GROUP BY 1, 3")
def context_lists(spark, sf):
    """The first five importers of each node, ranked before they are listed, so no list of all importers is held."""
    w = Window.partitionBy("dst").orderBy("src")
    five = imports(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 5")
    top = five.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("first_importers"))
    return table(spark, sf, "part", F.col("p_partkey").alias("node"), "p_name").join(top, "node")


BOOST = "CASE WHEN imported_by > 10 THEN .15 WHEN imported_by > 5 THEN .08 WHEN imported_by > 2 THEN .04 ELSE 0 END + CASE WHEN imports > 5 THEN .08 WHEN imports > 2 THEN .04 ELSE 0 END + CASE WHEN imports + imported_by > 15 THEN .12 WHEN imports + imported_by > 8 THEN .06 WHEN imports + imported_by > 3 THEN .03 ELSE 0 END + .05 * least(suppliers, 3)"


@q("graph_boost", CTX + f" SELECT node, round({BOOST}, 6)::DOUBLE AS boost, round(least((0.5 + node % 50 / 100.0) * (1 + {BOOST}), 0.99), 6)::DOUBLE AS score FROM c")
def graph_boost(spark, sf):
    b = R.graph_boost(F.col("imported_by"), F.col("imports"), F.col("imports") + F.col("imported_by"), F.col("suppliers"))
    return contexts(spark, sf).select("node", F.round(b, 6).alias("boost"), F.round(R.boosted(0.5 + F.col("node") % 50 / 100.0, b), 6).alias("score"))


@q("context_summary", CTX + " SELECT node, 'part ' || node || ': imported by ' || imported_by || ', imports ' || imports || CASE WHEN suppliers > 0 THEN ', suppliers ' || suppliers ELSE '' END AS summary FROM c")
def context_summary(spark, sf):
    s = F.concat_ws(", ", F.format_string("part %d: imported by %d", "node", "imported_by"), F.format_string("imports %d", "imports"), F.when(F.col("suppliers") > 0, F.format_string("suppliers %d", "suppliers")))
    return contexts(spark, sf).select("node", s.alias("summary"))


@q("indegree_prism", E_SQL + ", d AS (SELECT dst AS node, count(DISTINCT src) AS in_degree FROM imp GROUP BY 1) SELECT node, in_degree, round(1 / (1 + exp(-0.3 * (in_degree - 3))), 6) AS dependency FROM d")
def indegree_prism(spark, sf):
    return G.counts_by(imports(spark, sf), "dst", "in_degree").withColumn("dependency", F.round(R.sigmoid(0.3 * (F.col("in_degree") - 3)), 6))


@q("rel_stats", E_SQL + ", r AS (SELECT p_partkey, count(src) AS n FROM part LEFT JOIN imp ON src = p_partkey GROUP BY 1) SELECT count(*) AS nodes, count(*) FILTER (n > 0) AS linked, round(avg(n), 6) AS mean_links FROM r")
def rel_stats(spark, sf):
    n = imports(spark, sf).groupBy(F.col("src").alias("p_partkey")).agg(F.count("*").alias("n"))
    d = table(spark, sf, "part", "p_partkey").join(n, "p_partkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return d.agg(F.count("*").alias("nodes"), F.count_if(F.col("n") > 0).alias("linked"), F.round(F.avg("n"), 6).alias("mean_links"))


@q("project_stats", "SELECT c_nationkey AS project, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS finished FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def project_stats(spark, sf):
    """Distinct counts over a left join; orders are summed per customer first, so nothing is expanded."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderkey").alias("o"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("f"))
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(o, "c_custkey", "left")
    return c.groupBy(F.col("c_nationkey").alias("project")).agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("o"), F.lit(0)).alias("orders"), F.coalesce(F.sum("f"), F.lit(0)).alias("finished"))


LABELS = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")]


def nodes(spark, sf) -> DataFrame:
    out = None
    for label, key in LABELS:
        d = table(spark, sf, label, key).select(F.lit(label).alias("label"), F.col(key).cast("long").alias("id"))
        out = d if out is None else out.unionByName(d)
    return out


NODES = "WITH nodes AS (" + " UNION ALL ".join(f"SELECT '{a}' AS label, {k}::BIGINT AS id FROM {a}" for a, k in LABELS) + ")"


@q("label_counts", NODES + " SELECT label, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, label")
def label_counts(spark, sf):
    return nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@q("scalar_counts", NODES + " SELECT count(*) FILTER (label = 'part') AS parts, count(*) FILTER (label = 'supplier') AS suppliers, count(*) FILTER (label = 'method') AS methods FROM nodes")
def scalar_counts(spark, sf):
    return nodes(spark, sf).agg(*[F.count_if(F.col("label") == k).alias(k + "s") for k in ("part", "supplier", "method")])


@q("node_scan", "SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_name, p_partkey LIMIT 10")
def node_scan(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return p.join(F.broadcast(p.agg(F.min("p_brand").alias("p_brand"))), "p_brand").orderBy("p_name", "p_partkey").limit(10).select("p_partkey", "p_name")


@q("cross_project_edges", "SELECT n1.n_regionkey AS a, n2.n_regionkey AS b, count(*) AS n FROM (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY 1, 2")
def cross_project_edges(spark, sf):
    """Edges whose ends lie in different projects (regions)."""
    n = F.broadcast(table(spark, sf, "nation", "n_nationkey", "n_regionkey"))
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("a"))
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("b"))
    e = lines(spark, sf).join(table(spark, sf, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    return e.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


@q("purged_edges", E_SQL + " SELECT src, dst FROM imp WHERE src % 4 = dst % 4")
def purged_edges(spark, sf):
    return imports(spark, sf).where(F.col("src") % 4 == F.col("dst") % 4)


@q("orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def orphans(spark, sf):
    return table(spark, sf, "customer", "c_custkey").join(table(spark, sf, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority like '1%'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@q("missing_owners", "SELECT DISTINCT p.url FROM pages p WHERE p.page_id NOT IN (SELECT doc_id FROM labels) ORDER BY url LIMIT 100")
def missing_owners(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").join(table(spark, sf, "labels", "doc_id"), F.col("page_id") == F.col("doc_id"), "left_anti").select("url").distinct().orderBy("url").limit(100)


SPANS = "WITH f AS (SELECT o_custkey AS file, o_orderkey AS fn, o_orderkey % 400 AS s, o_orderkey % 400 + 15 AS e FROM orders), c AS (SELECT c_custkey AS file, k AS chunk, k * 50 AS s, k * 50 + 49 AS e FROM customer, range(8) t(k))"


def functions(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 400
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("fn"), k.alias("s"), (k + 15).alias("e"))


def spans(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer", "c_custkey")
    return c.select(F.col("c_custkey").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("chunk")).withColumn("cs", F.col("chunk") * 50).withColumn("ce", F.col("chunk") * 50 + 49)


#: Lines of a bin: about the length of a chunk.
BIN = 50


@q("overlapping_spans", SPANS + " SELECT f.file, chunk, fn, least(f.e, c.e) - greatest(f.s, c.s) + 1 AS lines FROM f JOIN c ON f.file = c.file AND f.s <= c.e AND c.s <= f.e")
def overlapping_spans(spark, sf):
    """Every function with every chunk that it shares a line with, and how many."""
    met = I.overlapping(functions(spark, sf), spans(spark, sf), ["file"], ("s", "e"), ("cs", "ce"), BIN)
    return met.select("file", "chunk", "fn", (F.least("e", "ce") - F.greatest("s", "cs") + 1).alias("lines"))


@q("range_containment", SPANS + " SELECT f.file, chunk, fn FROM f JOIN c ON f.file = c.file AND f.s >= c.s AND f.e <= c.e")
def range_containment(spark, sf):
    """Functions by the bin of their start, chunks in every bin that they touch."""
    return I.holding(functions(spark, sf), spans(spark, sf), ["file"], "s", "cs", "ce", BIN).where("e <= ce").select("file", "chunk", "fn")


@q("point_in_interval", SPANS + " SELECT f.file, chunk, count(*) AS symbols, min(fn) AS first_fn FROM f JOIN c ON f.file = c.file AND f.s BETWEEN c.s AND c.e GROUP BY 1, 2")
def point_in_interval(spark, sf):
    return I.holding(functions(spark, sf), spans(spark, sf), ["file"], "s", "cs", "ce", BIN).groupBy("file", "chunk").agg(F.count("*").alias("symbols"), F.min("fn").alias("first_fn"))


@q("call_edges", SPANS + " SELECT DISTINCT c.file AS caller_file, chunk, g.fn AS callee FROM f JOIN c ON f.file = c.file AND f.s BETWEEN c.s AND c.e JOIN f g ON g.file = f.file + 1 AND g.s = f.s")
def call_edges(spark, sf):
    """Calls by interval, callees by name; ambiguous names give several edges, equal ones are one."""
    at = I.holding(functions(spark, sf), spans(spark, sf), ["file"], "s", "cs", "ce", BIN).select(F.col("file").alias("caller_file"), "chunk", "s")
    g = functions(spark, sf).select((F.col("file") - 1).alias("caller_file"), "s", F.col("fn").alias("callee"))
    return at.join(g, ["caller_file", "s"]).select("caller_file", "chunk", "callee").distinct()


@q("provider_join", E_SQL + " SELECT src, list_sort(list(DISTINCT coalesce(p_name, 'module-' || dst))) AS providers FROM imp LEFT JOIN part ON dst = p_partkey AND p_size > 25 GROUP BY 1")
def provider_join(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_size").where("p_size > 25")
    j = imports(spark, sf).join(p, F.col("dst") == F.col("p_partkey"), "left")
    return j.groupBy("src").agg(F.array_sort(F.collect_set(F.coalesce("p_name", F.concat(F.lit("module-"), F.col("dst").cast("string"))))).alias("providers"))


@q("migrate_edges", E_SQL + " SELECT 'DEPENDS_ON' AS rel, dst AS src, src AS dst FROM imp WHERE src % 5 <> 0 UNION ALL SELECT 'IMPORTS', src, dst FROM imp WHERE src % 5 = 0")
def migrate_edges(spark, sf):
    """Retype and turn round one kind of edge, keep the rest."""
    e = imports(spark, sf).withColumn("rel", F.lit("IMPORTS"))
    moved = e.where("src % 5 <> 0").select(F.lit("DEPENDS_ON").alias("rel"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return moved.unionByName(e.where("src % 5 = 0").select("rel", "src", "dst"))


@q("migrate_nodes", "SELECT p_partkey AS part_id, upper(p_brand) AS brand, p_size * 10 AS size_mm, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END, 'part-' || p_partkey) AS label FROM part")
def migrate_nodes(spark, sf):
    """Transform, add, remove and rename properties."""
    name = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    d = table(spark, sf, "part").withColumn("p_brand", F.upper("p_brand")).withColumn("size_mm", F.col("p_size") * 10).withColumn("label", F.coalesce(name, F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))))
    return d.drop("p_type", "p_retailprice", "p_size", "p_name").withColumnsRenamed({"p_partkey": "part_id", "p_brand": "brand"})


@q("update_join", "SELECT c.c_custkey, coalesce(u.v, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) u ON c.c_custkey = u.k")
def update_join(spark, sf):
    u = table(spark, sf, "orders", "o_custkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return table(spark, sf, "customer", "c_custkey", "c_acctbal").join(u, "c_custkey", "left").select("c_custkey", F.coalesce("v", "c_acctbal").alias("c_acctbal"))


STORES = "WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 17 <> 3), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 23 = 5 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 19 <> 4), s AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing_in_a' WHEN b.doc_id IS NULL THEN 'missing_in_b' WHEN a.h = b.h THEN 'synced' ELSE 'mismatch' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id)"


def stores(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents", "doc_id", "text")
    i = F.col("doc_id")
    return d.where(i % 17 != 3).select("doc_id", F.md5("text").alias("h")), d.where(i % 19 != 4).select("doc_id", F.md5(F.when(i % 23 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))


def states(spark, sf) -> DataFrame:
    return S.compare(*stores(spark, sf), "doc_id", "h")


Q["store_states"] = (states, STORES + " SELECT * FROM s")


@q("drift_report", STORES + ", c AS (SELECT count(*) AS sampled, count(*) FILTER (state = 'missing_in_a') AS missing_in_a, count(*) FILTER (state = 'missing_in_b') AS missing_in_b, count(*) FILTER (state = 'mismatch') AS mismatch, count(*) FILTER (state <> 'synced') / count(*)::DOUBLE AS r FROM s) SELECT sampled, missing_in_a, missing_in_b, mismatch, round(r, 6) AS rate, CASE WHEN r = 0 THEN 'consistent' WHEN r <= .05 THEN 'minor' WHEN r <= .1 THEN 'moderate' ELSE 'severe' END AS verdict FROM c")
def drift_report(spark, sf):
    return S.drift(states(spark, sf))


@q("sync_rate", STORES + " SELECT round(count(*) FILTER (state IN ('synced', 'mismatch')) / count(*)::DOUBLE, 6) AS rate, count(*) FILTER (state IN ('synced', 'mismatch')) / count(*)::DOUBLE >= .95 AS healthy, round(100.0 * least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) / (SELECT count(*) FROM a), 6) AS count_rate, round(abs((SELECT count(*) FROM a) - (SELECT count(*) FROM b)) / greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b), 1)::DOUBLE, 6) AS count_drift FROM s")
def sync_rate(spark, sf):
    both = F.col("state").isin("synced", "mismatch")
    a, b = F.count_if(F.col("state") != "missing_in_a"), F.count_if(F.col("state") != "missing_in_b")
    r = F.count_if(both) / F.count("*")
    return states(spark, sf).agg(F.round(r, 6).alias("rate"), (r >= 0.95).alias("healthy"), F.round(100.0 * F.least(a, b) / a, 6).alias("count_rate"), F.round(F.abs(a - b) / F.greatest(a, b, F.lit(1)), 6).alias("count_drift"))


@q("only_in_one", STORES + " SELECT 'a' AS side, doc_id FROM s WHERE state = 'missing_in_b' UNION ALL SELECT 'b', doc_id FROM s WHERE state = 'missing_in_a'")
def only_in_one(spark, sf):
    a, b = stores(spark, sf)
    return a.join(b, "doc_id", "left_anti").select(F.lit("a").alias("side"), "doc_id").unionByName(b.join(a, "doc_id", "left_anti").select(F.lit("b").alias("side"), "doc_id"))


@q("synced_count", STORES + " SELECT count(*) AS n FROM s WHERE state IN ('synced', 'mismatch')")
def synced_count(spark, sf):
    a, b = stores(spark, sf)
    return a.join(b, "doc_id", "left_semi").agg(F.count("*").alias("n"))


@q("chunk_diff", STORES + " SELECT doc_id, CASE state WHEN 'missing_in_a' THEN 'new' WHEN 'missing_in_b' THEN 'deleted' ELSE 'changed' END AS change FROM s WHERE state <> 'synced'")
def chunk_diff(spark, sf):
    change = F.when(F.col("state") == "missing_in_a", "new").when(F.col("state") == "missing_in_b", "deleted").otherwise("changed")
    return states(spark, sf).where("state <> 'synced'").select("doc_id", change.alias("change"))


@q("repair_plan", STORES + " SELECT doc_id, CASE state WHEN 'missing_in_b' THEN 'copy_to_b' WHEN 'missing_in_a' THEN 'delete_orphan' ELSE 'copy_from_a' END AS action FROM s WHERE state <> 'synced'")
def repair_plan(spark, sf):
    return S.repair_plan(states(spark, sf), "doc_id")


@q("repaired_store", STORES + " SELECT doc_id, h FROM a")
def repaired_store(spark, sf):
    """Store b after its repair plan: orphans deleted, the rest copied from a."""
    a, b = stores(spark, sf)
    plan = S.repair_plan(states(spark, sf), "doc_id")
    kept = S.delete(b, plan.where("action = 'delete_orphan'"), ["doc_id"])
    return S.upsert(kept, a.join(plan.where("action <> 'delete_orphan'").select("doc_id"), "doc_id", "left_semi"), ["doc_id"])


@q("upserted", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 2 UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 10 = 3")
def upserted(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    new = c.where(k % 10 == 1).withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where(k % 10 == 3).withColumn("c_custkey", k + 1000000))
    return S.upsert(c.where(k % 10 != 2), new, ["c_custkey"])


@q("purged_project", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def purged_project(spark, sf):
    gone = F.broadcast(table(spark, sf, "nation", "n_nationkey", "n_regionkey").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")))
    return S.delete(table(spark, sf, "customer", "c_custkey", "c_nationkey"), gone, ["c_nationkey"])


@q("relabelled_nodes", """
WITH n AS (SELECT vec_id, CASE WHEN label < 5 THEN 'Chunk' ELSE 'Doc' END AS kind, CASE WHEN vec_id % 3 = 0 THEN 'c' || vec_id END AS chunk_id, CASE WHEN vec_id % 3 = 1 THEN 'i' || vec_id END AS id FROM embeddings)
SELECT coalesce(chunk_id, id, vec_id::VARCHAR) AS key, CASE kind WHEN 'Chunk' THEN 'CodeChunk' ELSE kind END AS kind, kind AS undone FROM n""")
def relabelled_nodes(spark, sf):
    """Nodes of one label under a new one, each with a key repaired from the first of three that it has, and the label after the change is undone."""
    v = F.col("vec_id").cast("string")
    n = table(spark, sf, "embeddings", "vec_id", "label").select(F.when(F.col("label") < 5, "Chunk").otherwise("Doc").alias("kind"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("c"), v)).alias("chunk_id"), F.when(F.col("vec_id") % 3 == 1, F.concat(F.lit("i"), v)).alias("id"), v.alias("qdrant_id"))
    done = G.relabel(n, "kind", "Chunk", "CodeChunk", "key", ["chunk_id", "id", "qdrant_id"])
    undone = G.relabel(done, "kind", "CodeChunk", "Chunk", "key", ["key"]).select("key", F.col("kind").alias("undone"))
    return done.select("key", "kind").join(undone, "key")


@q("migrated_collection", """
WITH e AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, 'project-' || label AS project, 2 AS version, len(v)::INT AS dims, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 5) AS total FROM e""")
def migrated_collection(spark, sf):
    """A vector collection under a new schema: a field renamed and one added, vectors made anew with half the dimensions, at unit length."""
    half = F.slice("embedding", 1, 32)
    m = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("project-"), F.col("label").cast("string")).alias("project"), F.lit(2).alias("version"), F.transform(half, lambda x: x.cast("double") / V.norm(half)).alias("v"))
    return m.select("vec_id", "project", "version", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@q("stable_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= greatest(10, least(n // 100, 1000))")
def stable_sample(spark, sf):
    """A hundredth of the documents, within 10 and 1,000."""
    d = table(spark, sf, "documents", "doc_id")
    return S.stable_sample(d, "doc_id", S.sample_size(d.count()))


@q("zip_by_id", "SELECT d.doc_id, e.label, left(d.text, 20) AS head FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def zip_by_id(spark, sf):
    """Texts with their vectors: by id, never by position."""
    return table(spark, sf, "documents", "doc_id", "text").join(table(spark, sf, "embeddings", "vec_id", "label"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "label", F.substring("text", 1, 20).alias("head"))


@q("inconsistent_projects", "SELECT source AS project, count(*) AS n FROM documents WHERE source IS NULL OR contains(source, '1') OR source IN ('src0', 'src2') GROUP BY 1")
def inconsistent_projects(spark, sf):
    s = F.col("source")
    return table(spark, sf, "documents", "source").where(s.isNull() | s.contains("1") | s.isin("src0", "src2")).groupBy(s.alias("project")).agg(F.count("*").alias("n"))


CATALOG = [("event", "signup", "k"), ("event", "click", "k"), ("event", "view", "j")]


@q("schema_introspection", "SELECT event_type AS label, unnest(json_keys(props)) AS property, count(*) AS n FROM events GROUP BY 1, 2")
def schema_introspection(spark, sf):
    e = table(spark, sf, "events", "event_type", "props")
    return e.select(F.col("event_type").alias("label"), F.explode(F.json_object_keys("props")).alias("property")).groupBy("label", "property").agg(F.count("*").alias("n"))


@q("schema_conformance", "WITH c(kind, event_type, required) AS (VALUES ('event', 'signup', 'k'), ('event', 'click', 'k'), ('event', 'view', 'j')) SELECT event_type, count(*) AS n, count(*) FILTER (NOT list_contains(json_keys(props), required)) AS failed FROM events JOIN c USING (event_type) GROUP BY 1")
def schema_conformance(spark, sf):
    c = F.broadcast(spark.createDataFrame(CATALOG, "kind string, event_type string, required string").groupBy("event_type").agg(F.collect_list("required").alias("required")))
    e = table(spark, sf, "events", "event_type", "props").join(c, "event_type")
    missing = F.size(F.array_except("required", F.json_object_keys("props"))) > 0
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(missing).alias("failed"))


#: Relationships of the catalog: type, label of the source, label of the target.
RELATIONS = [("SUPPLIES", "supplier", "part"), ("CONTAINS", "order", "part"), ("PLACED", "customer", "order")]


@q("relation_conformance", "WITH c(rel, a, b) AS (VALUES " + ", ".join(map(str, RELATIONS)) + """),
e AS (SELECT 'SUPPLIES' AS rel, CASE WHEN l_linenumber = 7 THEN 'order' ELSE 'supplier' END AS a, 'part' AS b FROM lineitem UNION ALL SELECT 'CONTAINS', 'order', 'part' FROM lineitem
  UNION ALL SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'OWNS' ELSE 'PLACED' END, 'customer', CASE WHEN o_orderkey % 40 = 1 THEN 'part' ELSE 'order' END FROM orders)
SELECT e.rel, e.a AS source, e.b AS target, count(*) AS n, e.rel IN (SELECT rel FROM c) AS declared, bool_or(c.rel IS NOT NULL) AS allowed FROM e LEFT JOIN c ON c.rel = e.rel AND c.a = e.a AND c.b = e.b GROUP BY e.rel, e.a, e.b""")
def relation_conformance(spark, sf):
    """Edges by type and labels of their ends: whether the type is declared, and allowed between these labels."""
    c = F.broadcast(spark.createDataFrame(RELATIONS, "rel string, source string, target string"))
    line, order = table(spark, sf, "lineitem", "l_linenumber"), table(spark, sf, "orders", "o_orderkey")
    edge = lambda df, r, a, b: df.select(r.alias("rel"), a.alias("source"), b.alias("target"))
    e = edge(line, F.lit("SUPPLIES"), F.when(F.col("l_linenumber") == 7, "order").otherwise("supplier"), F.lit("part")).unionByName(edge(line, F.lit("CONTAINS"), F.lit("order"), F.lit("part")))
    e = e.unionByName(edge(order, F.when(F.col("o_orderkey") % 50 == 0, "OWNS").otherwise("PLACED"), F.lit("customer"), F.when(F.col("o_orderkey") % 40 == 1, "part").otherwise("order")))
    known, pair = c.select("rel").distinct().withColumn("declared", F.lit(True)), c.withColumn("allowed", F.lit(True))
    d = e.groupBy("rel", "source", "target").agg(F.count("*").alias("n")).join(F.broadcast(known), "rel", "left").join(F.broadcast(pair), ["rel", "source", "target"], "left")
    return d.select("rel", "source", "target", "n", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("allowed", F.lit(False)).alias("allowed"))


@q("schema_diff", "WITH d(name) AS (VALUES ('signup'), ('click'), ('view'), ('refund')), a AS (SELECT DISTINCT event_type AS name FROM events) SELECT name, 'undeclared' AS kind FROM a WHERE name NOT IN (SELECT name FROM d) UNION ALL SELECT name, 'unused' FROM d WHERE name NOT IN (SELECT name FROM a)")
def schema_diff(spark, sf):
    d = spark.createDataFrame([("signup",), ("click",), ("view",), ("refund",)], "name string")
    a = table(spark, sf, "events", F.col("event_type").alias("name")).distinct()
    return a.join(F.broadcast(d), "name", "left_anti").select("name", F.lit("undeclared").alias("kind")).unionByName(d.join(a, "name", "left_anti").select("name", F.lit("unused").alias("kind")))


@q("pending_migrations", "SELECT n_nationkey::INT AS version, n_name AS name, (SELECT max(n_nationkey) + 1 FROM nation)::INT AS next_version FROM nation WHERE n_nationkey > 5 AND n_nationkey <= 15 AND n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) ORDER BY 1")
def pending_migrations(spark, sf):
    n = table(spark, sf, "nation")
    top = F.broadcast(n.agg((F.coalesce(F.max("n_nationkey"), F.lit(0)) + 1).cast("int").alias("next_version")))
    left = n.where("n_nationkey > 5 and n_nationkey <= 15").join(n.where("n_regionkey = 2").select("n_nationkey"), "n_nationkey", "left_anti")
    return left.crossJoin(top).select(F.col("n_nationkey").cast("int").alias("version"), F.col("n_name").alias("name"), "next_version").orderBy("version")


@q("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels)")
def set_operations(spark, sf):
    a, b = table(spark, sf, "documents", "doc_id").where("doc_id % 2 = 0"), table(spark, sf, "labels", "doc_id")
    count = lambda d, op: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(a.subtract(b), "except"))
