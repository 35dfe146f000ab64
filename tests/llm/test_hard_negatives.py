"""Operator 13 against brute force and SQL; pruning on vectors of low rank."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import same_as_sql
from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    fine = [(n, i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for n, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for n, i, label, v in fine:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), late(j), m, j, x) for m, j, x, w in fine if m != n and len(w) == len(v)), key=lambda r: r[:3])
        for s, _, _, j, _ in [r for r in scored if r[4] == label][:5]:
            fits = [r for r in scored if r[4] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, r[3], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out, key=str)


def awkward():
    rng = np.random.default_rng(3)
    f = lambda x: np.asarray(x, np.float32).tolist()
    base = rng.normal(size=(6, 12))
    out = [(i, f(base[i % 6] + 0.3 * rng.normal(size=12)), int(rng.integers(0, 4))) for i in range(300)]
    out += [(400 + i, f(base[0]), 1 + i % 2) for i in range(80)]  # one vector, many rows
    out += [(100, f(base[0]), 1), (100, f(base[0]), 1), (None, f(base[1]), 2), (None, f(base[1]), 3)]
    out += [(600, None, 1), (601, f(base[0]), None), (602, [1.0, None], 1), (603, f([float("nan")] * 12), 1), (604, f([float("inf")] * 12), 1), (700, [], 1), (701, [], 2), (702, [], 2), (800, f([1.5, -2.0]), 3), (801, f([1.0, -2.5]), 3), (803, f([1.4, -2.0]), 4)]
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("values", [1 << 18, 256])
def test_same_as_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(H, "VALUES", values)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"uid": F.lit("clash"), "v": F.lit(1), "dims": F.lit(None)})
    want = brute(rows)
    assert len(want) > 50 and got(H.hard_negatives(df)) == want


def test_few_rows(spark):
    assert got(H.hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert got(H.hard_negatives(spark.createDataFrame([(100, [1.0], 1), (1, None, 1)], SCHEMA))) == []
    rows = [(200, [0.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 2)]
    assert got(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(200, 1, 1, 2, 0, 0)]


def test_query_and_sql(spark, duck, sf):
    same_as_sql(H.query(spark, sf), duck, H.SQL)


def test_rotation_prunes_vectors_of_low_rank(spark):
    """Energy in six hidden directions: after the first stages few pairs are left, and none that counts is lost."""
    rng = np.random.default_rng(7)
    m = np.floor(256 * (rng.normal(size=(600, 6)) @ rng.normal(size=(6, 64)) + 0.02 * rng.normal(size=(600, 64))))
    rows = spark.createDataFrame([(64, v.tolist()) for v in m], "dims int, v array<double>")
    turn = H.rotations(rows)
    assert np.allclose(turn[64] @ turn[64].T, np.eye(64)) and np.allclose(turn[64], np.linalg.eigh(m.T @ m)[1][:, ::-1] * np.sign((turn[64] * np.linalg.eigh(m.T @ m)[1][:, ::-1]).sum(0)), atol=1e-4)
    side = lambda a: H.Side(pa.array([{"uid": i, "vec_id": i, "label": 0, "v": v.tolist()} for i, v in enumerate(a)]), turn)
    q, x = side(m[:30]), side(m)
    i, j, s = H.in_order(x, *H.survivors(q, x, q.uid[:, None] != x.uid, lambda low, high: high >= H.kth(low, 5)[:, None]))
    assert len(i) < 0.05 * 30 * 600
    exact = (m[:30] @ m.T).astype(np.int64)
    for a in range(30):
        assert s[i == a][:5].tolist() == sorted((exact[a, b] for b in range(600) if b != a), reverse=True)[:5]
