"""How work is dealt over tasks."""

import os
import random

from pyspark.sql import functions as F

from conftest import same_as_sql
from tessera.operators import graph as G
from tessera.operators import layout as L
from tessera.operators import text_index as T
from tessera.operators import vector_index as VI
from tessera.plans import code, graph
from tessera.sources.shared import shared_dir


def test_lines_of_a_file_are_dealt_once_and_by_count(spark, monkeypatch):
    """Windows and lists of a file follow one shuffle of whole files, over as many tasks as the files ask for."""
    monkeypatch.setattr(L, "TASK_FILES", 2)
    files = spark.createDataFrame([(i, "def f():\n    return 1\n\ndef g():\n    return (1,\n        2)") for i in range(40)], "k long, source string")
    filed = L._filed(L.lines(files, "k", "source"), "k")
    assert filed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert filed.rdd.getNumPartitions() == 20
    assert [(r["name"], r["start_line"], r["end_line"]) for r in L.symbols(files, "k", "source").where("k = 7").orderBy("start_line").collect()] == [("f", 1, 2), ("g", 4, 6)]


def test_texts_come_with_their_definitions(spark, duck, sf):
    """No join and nothing sent to the driver: a planner takes rendered texts for small, whatever their number."""
    f, sql = code.Q["definition_chunks"]
    got = f(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    same_as_sql(got, duck, sql)
    files = spark.createDataFrame([(1, "\ndef f():\n    return 1\n\n\ndef g(): pass"), (2, None)], "k long, source string")
    assert sorted(r["content"] for r in L.symbols(files, "k", "source", texts=True).collect()) == ["def f():\n    return 1", "def g(): pass"]


def test_counts_of_reach_without_its_pairs(spark, monkeypatch):
    """The same counts as the pairs give, over several sets of starts; starts without a step are left out."""
    monkeypatch.setattr(G, "WORDS", 2)
    monkeypatch.setattr(G, "WORD", 3)
    random.seed(4)
    edges = spark.createDataFrame([(random.randrange(60), random.randrange(60)) for _ in range(90)], "src long, dst long")
    start = spark.createDataFrame([(i,) for i in range(0, 70, 2)], "node long")
    for direction in ("out", "in"):
        want = {r["start"]: (r["d"], r["t"]) for r in G.reach(edges, start, 3, direction=direction).groupBy("start").agg(F.count_if(F.col("hop") == 1).alias("d"), F.count("*").alias("t")).collect()}
        assert {r["start"]: (r["direct"], r["transitive"]) for r in G.reach_counts(edges, start, 3, direction=direction).collect()} == want


def test_a_sketch_goes_once_to_each_block(spark, monkeypatch):
    """Sizes do not depend on the blocks, and the session's settings stay."""
    edges = spark.createDataFrame([(i, (i * 7 + j) % 50) for i in range(50) for j in range(3)], "src long, dst long")
    held, got = spark.conf.get(G.HELD), []
    for width in (1, 20, 200_000):
        monkeypatch.setattr(G, "BLOCK_NODES", width)
        got.append(sorted(map(tuple, G.reach_sizes(edges, 3).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 50 and spark.conf.get(G.HELD) == held


def test_sketches_leave_the_disk(spark, tmp_path):
    """Steps are packed without a shuffle, and of a count only the numbers stay; a node counts itself only if a cycle returns to it."""
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (5, 5), (6, 7), (7, 6), (90, 2), (91, 90), (-3, 6)]
    df = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(1).sortWithinPartitions("src")
    df.write.parquet(f"file://{tmp_path}/e")
    df = spark.read.parquet(f"file://{tmp_path}/e")
    rows = G.packed(df.selectExpr("dst as src", "src as dst"), 4)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["dst"], r["block"] * 4 + t) for r in rows.collect() for t in r["takers"]}
    assert got == set(edges) and {r["dst"] for r in rows.where("own").collect()} == {a for a, _ in edges}
    home = shared_dir(spark).removeprefix("file://") + f"/tessera-stored/{spark.sparkContext.applicationId}"
    for direction in ("in", "out"):
        before = set(os.listdir(home)) if os.path.exists(home) else set()
        sizes = G.reach_sizes(df, 3, direction=direction, ready=True)
        assert [x.split("-")[0] for x in set(os.listdir(home)) - before] == ["sizes"]
        step = {}
        for a, b in edges:
            step.setdefault(*((a, set()) if direction == "out" else (b, set()))).add(b if direction == "out" else a)
        want = {}
        for n in step:
            want[n], front = set(), {n}
            for _ in range(3):
                front = set().union(*(step.get(x, set()) for x in front))
                want[n] |= front
        assert {r["node"]: r["reached"] for r in sizes.collect()} == {n: len(x) for n, x in want.items()}


def test_edges_of_all_lines_are_shuffled_once(spark, sf):
    plan = graph.found_imports(spark, sf)._jdf.queryExecution().executedPlan().toString()
    pairs = [x for x in plan.split("\n") if "Exchange hashpartitioning(src" in x]
    assert len(pairs) == 1 and "dst" not in pairs[0].split("hashpartitioning(")[1].split(")")[0]


def test_hits_add_up_in_their_block(spark, monkeypatch, tmp_path):
    """Texts are shuffled once by block, and the hits of many queries not at all: only packed postings and one row a query and document kept."""
    monkeypatch.setattr(T, "BLOCK", 4)
    docs = spark.createDataFrame([(i, "the common word " * (i % 5 + 1)) for i in range(64)] + [(70, None), (1, "the more")], "id long, text string")
    T.build(docs, f"file://{tmp_path}/i", "id")
    index = T.TextIndex(spark, f"file://{tmp_path}/i")
    assert index.stats.first()["n"] == 65 and index.terms.where("token = 'the'").first()["df"] == 64
    assert not (tmp_path / "i" / "counts").exists()
    q = spark.createDataFrame([(i, w) for i in range(9) for w in ("the", "word")], "item int, token string")
    asked, opened = index.asked(q)
    scores = index.scores(asked, opened, opened.select("block").distinct().crossJoin(q.select("item").distinct()))
    joined = scores._jdf.queryExecution().executedPlan().toString()
    last = joined.split("Generate explode")[0]
    assert "Exchange" not in last
    assert scores.count() == 9 * 64 and scores.exceptAll(index.scores(asked, opened)).isEmpty()


def test_lists_meet_queries_in_products(spark, monkeypatch, tmp_path):
    """Slices of lists and blocks of queries give the rows of a scan, ties to the smaller key; scores are made in tasks of whole lists, not a row a pair."""
    monkeypatch.setattr(VI, "SLICE", 7)
    monkeypatch.setattr(VI, "QUERIES", 3)
    random.seed(5)
    vecs = [[random.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for _ in range(90)]
    rows = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>")
    VI.build(rows, f"file://{tmp_path}/v", "vec_id", lists=3)
    index = VI.VectorIndex(spark, f"file://{tmp_path}/v", "vec_id")
    got = index.exact(rows.where("vec_id % 9 = 0").selectExpr("vec_id as qid", "embedding as q"), 6, 1)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)
    want = {i: sorted((-cos(vecs[i], v), j) for j, v in enumerate(vecs))[:6] for i in range(0, 90, 9)}
    found = {i: [] for i in want}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found[r["qid"]].append((-r["score"], r["vec_id"]))
    assert found == want
