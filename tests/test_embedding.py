"""Embeddings by a given model and by the stand-in."""

import numpy as np

from tessera.operators import embedding as B


def test_any_model_in_batches(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, "ccc")] + [(i, "x" * (i % 7)) for i in range(10, 60)], "id long, text string").repartition(2)
    model = lambda texts: np.array([[len(t), t.count("c"), 0.0] for t in texts]) if len(texts) <= 16 else 1 / 0
    got = {r["id"]: r["embedding"] for r in B.embedded(docs, "id", model=model, prefix="", batch=16).collect()}
    assert len(got) == 53 and got[1] == [1.0, 0.0, 0.0] and got[2] == [0.0, 0.0, 0.0] and np.allclose(got[3], np.array([3, 3, 0]) / 18**0.5)
    longer = B.embedded(docs, "id", model=lambda t: np.array([[float(x.startswith("task: ")), 0] for x in t]), prefix="task: ").collect()
    assert all(r["embedding"] == [1.0, 0.0] for r in longer)


def test_stand_in(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, None), (5, "")], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in B.embedded(docs, "id").collect()}
    assert all(v.shape == (768,) and abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
    assert (got[1] == got[2]).all() and (got[4] == got[5]).all() and abs(got[1] @ got[3]) < 0.2
    want = np.random.default_rng(0x51037A4A).standard_normal(768)  # md5 of "same" begins with these digits
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6)


def test_nothing(spark):
    assert B.embedded(spark.createDataFrame([], "id long, text string"), "id").count() == 0
