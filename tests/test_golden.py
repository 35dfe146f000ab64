"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.operators import retrieval as R
from tessera.operators import rules as X
from tessera.operators import sync as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def hits(spark, rows):
    return spark.createDataFrame(rows, "src string, file string, id long, score double")


def test_rrf(spark):
    r = {x["file"]: x for x in R.rrf(hits(spark, [("A", "f1", 1, 0.9), ("A", "f2", 2, 0.8), ("B", "f2", 3, 0.9), ("B", "f3", 4, 0.8)]), "file", "src", "id").collect()}
    assert r["f2"]["rrf"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and r["f1"]["rrf"] == pytest.approx(1 / 61, abs=1e-9) and r["f3"]["rrf"] == pytest.approx(1 / 62, abs=1e-9)


def test_rrf_repeat_adds_up(spark):
    r = R.rrf(hits(spark, [("A", "f1", 1, 0.9), ("A", "f1", 2, 0.8)]), "file", "src", "id").first()
    assert r["rrf"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and r["num_sources"] == 1 and r["best"] == 1


def test_bm25_saturation(spark):
    assert one(spark, R.bm25_tf(F.lit(1), F.lit(100))) == pytest.approx(1.0)


@pytest.mark.parametrize("scores, k", [([0.9, 0.85, 0.4, 0.35], 2), ([0.5], 1), ([0.9, 0.5, 0.1], 1)])
def test_knee(spark, scores, k):
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "q int, id int, score double")
    assert R.knee(d, ["q"], "id").first()["k"] == k


def test_graph_boost(spark):
    b = R.graph_boost(F.lit(11), F.lit(6), F.lit(16), F.lit(4))
    assert one(spark, b) == pytest.approx(0.5) and one(spark, R.boosted(F.lit(0.5), b)) == pytest.approx(0.75)
    assert one(spark, R.boosted(F.lit(0.999), F.lit(0.0))) == 0.99


def test_recency(spark):
    assert one(spark, R.recency_linear(F.lit(15))) == pytest.approx(1.15)
    assert [one(spark, R.recency_step(F.lit(d))) for d in (7, 30, 365)] == [1.1, 1.0, 0.9]


def test_quantize(spark):
    d = spark.createDataFrame([([0.0, 0.5, 1.0],)], "v array<float>")
    assert d.select(V.int8("v")).first()[0] == [0, 128, 255]
    d = spark.createDataFrame([([0.1, -0.2, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0],), ([1.0] * 9,)], "v array<float>")
    assert [r[0] for r in d.select(V.bits("v")).collect()] == [[0x90], [255, 128]]
    d = spark.createDataFrame([([0.0, 1.0, 0.5],)], "v array<float>")
    assert d.select(V.int4("v")).first()[0] == [15, 128]


def test_percentiles(spark):
    d = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert M.floor_index_percentiles(d, ["g"], "v", {"p": 0.95}).first()["p"] == 96
    assert M.exclusive_percentile(d, ["g"], "v", 0.95, "p").first()["p"] == pytest.approx(95.95)
    assert M.exclusive_percentile(d.limit(1), ["g"], "v", 0.95, "p").first()["p"] is None
    same = spark.createDataFrame([("g", 5.0)] * 9 + [("g", None), ("h", 1.0), ("h", 2.0)], "g string, v double")
    assert {r["g"]: (r["n"], r["p"]) for r in M.floor_index_percentiles(same, ["g"], "v", {"p": 0.5}).collect()} == {"g": (9, 5.0), "h": (2, 2.0)}


def test_drift(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, h string")
    b = spark.createDataFrame([(2, "x"), (3, "y"), (4, "x")], "id int, h string")
    r = S.drift(S.compare(a, b, "id", "h")).first()
    assert (r["missing_in_b"], r["missing_in_a"], r["mismatch"], r["rate"], r["verdict"]) == (1, 1, 1, 0.75, "severe")


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = {(r["node"], r["hop"]) for r in G.reach(e, spark.createDataFrame([(1,)], "node int"), 5).collect()}
    assert got == {(2, 1), (3, 2), (1, 3), (4, 3)}


def test_rules(spark):
    files = spark.createDataFrame([(1, "dist/x"), (2, "a/dist/x"), (3, "src/t.txt")], "id int, path string")
    rules = X.rule_table(spark, ["**/dist/**", "# no", "!deprioritize:*.txt,0.4", "!deprioritize:src/*,0.6"])
    assert sorted(r["id"] for r in X.not_excluded(files, rules).collect()) == [1, 3]
    assert {r["id"]: r["penalty"] for r in X.penalties(files, rules, "id").collect()} == {1: 0.0, 2: 0.0, 3: 0.6}


def test_text(spark):
    assert one(spark, T.slug(F.lit("--My Project_1!"))) == "my-project-1"
    assert one(spark, T.content_id(F.lit("a"))) == 912392414677810140
    assert one(spark, T.line_number(F.lit("a\nb\nc"), F.lit(3))) == 2


def test_mmr(spark):
    d = spark.createDataFrame([("q", 1, 0.9, 100), ("q", 2, 0.89, 100), ("q", 3, 0.8, 1000)], "q string, id long, score double, size long")
    assert [r["id"] for r in R.mmr(d, "q", 2, 0.5).orderBy("place").collect()] == [1, 3]


def test_cascade(spark):
    a, b = (spark.createDataFrame(x, "id int, score double") for x in ([], [(7, 0.1)]))
    assert [(r["id"], r["stage"]) for r in R.first_stage(a, b).collect()] == [(7, 1)]
