"""The stored indexes against scans: same rows, texts and unprobed lists unread, recall measured."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import text_index as T
from tessera.operators import vector_index as VI
from tessera.plans import indexes, registry
from tessera.sources.tables import table

random.seed(2)


def bm25(docs, queries):
    """Plain scores (item, doc) -> (terms, score)."""
    held = {d: collections.Counter(re.findall("[a-z0-9_]+", (t or "").lower())) for d, t in docs}
    size = {d: sum(c.values()) for d, c in held.items()}
    mean, out = sum(size.values()) / len(held), {}
    for item, words in queries.items():
        for w in set(words):
            df = sum(w in c for c in held.values())
            for d, c in held.items():
                if c[w]:
                    n, s = out.get((item, d), (0, 0.0))
                    out[item, d] = n + 1, s + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean))
    return out


def test_text_index_same_as_plain_scores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "BLOCK", 8)
    words = [f"w{int(random.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 60))) + (" the" if i % 3 else "")) for i in range(300)] + [(900, None), (901, ""), (902, "The THE the\nlone_word")]
    T.build(spark.createDataFrame(docs, "id long, text string").repartition(4), f"file://{tmp_path}/i", "id")
    index = T.TextIndex(spark, f"file://{tmp_path}/i")
    queries = {1: ["the", "w1", "w2"], 2: ["lone_word", "the"], 3: ["absent"], 4: words[:30]}
    q = spark.createDataFrame([(i, w) for i, ws in queries.items() for w in ws], "item int, token string")
    want = bm25(docs, queries)
    got = {(r["item"], r["doc"]): (r["terms"], r["score"]) for r in index.scores(*index.asked(q)).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    for seeds in (1, 4):
        best = collections.defaultdict(list)
        for r in sorted(index.top_k(q, 5, seeds).collect(), key=lambda r: r["rank"]):
            best[r["item"]].append(r["doc"])
        assert dict(best) == {i: [d for _, d in sorted((-s, d) for (j, d), (_, s) in got.items() if j == i)[:5]] for i in (1, 2, 4)}
    hot = index.postings.where("token = 'the'")
    assert hot.count() > 30 and hot.agg(F.max(F.size("docs"))).first()[0] <= 3 * T.BLOCK  # a hot token is many rows


def test_blocks_below_the_bound_are_skipped(spark, monkeypatch, tmp_path):
    """One document holds the rare word many times; most blocks of the common word cannot reach it."""
    monkeypatch.setattr(T, "BLOCK", 4)
    docs = [(i, "common filler " * 20) for i in range(200)] + [(500 + i, "rare rare rare common") for i in range(3)]
    T.build(spark.createDataFrame(docs, "id long, text string"), f"file://{tmp_path}/i", "id")
    index, seen = T.TextIndex(spark, f"file://{tmp_path}/i"), []
    scores = index.scores
    index.scores = lambda a, o, b=None: (seen.append(b.count()), scores(a, o, b))[1]
    got = index.top_k(spark.createDataFrame([(0, "rare"), (0, "common")], "item int, token string"), 3, 3).collect()
    assert sorted(r["doc"] for r in got) == [500, 501, 502] and seen[0] == 3 and seen[1] == 0


def test_no_text_is_read_once_the_index_is_there(spark, sf):
    for name in ("bm25_search", "many_query_bm25"):
        files = registry.queries()[name](spark, sf).inputFiles()
        assert any("/text-index" in f for f in files) and not any("documents.parquet" in f for f in files)


def test_a_changed_file_gets_a_new_index(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    find = lambda: T.index_of(spark.read.parquet(path), "id").terms.count()
    spark.createDataFrame([(1, "a b")], "id long, text string").write.parquet(path)
    assert find() == 2 and find() == 2
    spark.createDataFrame([(2, "c d e")], "id long, text string").write.mode("append").parquet(path)
    assert find() == 5


def test_recall_and_share_of_rows_read(spark):
    sf = "/root/testdata/sf0.01"
    index, k = indexes.vector_index(spark, sf), indexes.K
    queries = indexes.queries(spark, sf)
    truth = {(r["qid"], r["vec_id"]) for r in index.exact(queries, k).collect()}
    found = {(r["qid"], r["vec_id"]) for r in indexes.ivf_search(spark, sf).collect()}
    assert len(truth & found) >= 0.9 * len(truth)
    read = index.near_lists(queries).where(F.col("place") <= indexes.probes(spark, sf)).agg(F.sum("rows")).first()[0] / (table(spark, sf, "embeddings").count() * queries.count())
    print("share of rows read", read)
    assert read <= 1


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.4).astype(np.float32).tolist()) for i in range(1200)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16)]
    at = f"file://{tmp_path_factory.mktemp('ivf')}/i"
    VI.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), at, "vec_id")
    return rows, VI.VectorIndex(spark, at, "vec_id")


def test_lists_hold_every_usable_row_and_prune(spark, clustered):
    rows, index = clustered
    assert sorted(r[0] for r in index.rows.select("vec_id").collect()) == list(range(1200))
    asked = [r for r in rows[:1200] if r[0] % 100 == 0]
    q = spark.createDataFrame(asked, "qid long, q array<float>")
    m = np.array([v for _, v in rows[:1200]], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = {i: sorted(range(1200), key=lambda j: (-round(float(m[i] @ m[j]), 6), j))[:10] for i, _ in asked}
    got = collections.defaultdict(list)
    for r in sorted(index.exact(q, 10).collect(), key=lambda r: r["rank"]):
        got[r["qid"]].append(r["vec_id"])
    assert got == want
    truth = index.exact(q, 10)
    probes = index.probes_for(q, truth, 0.95)
    near = index.near_lists(q)
    assert near.where(F.col("place") <= probes).agg(F.sum("rows")).first()[0] < 0.4 * 1200 * len(asked)
    found = {(r["qid"], r["vec_id"]) for r in index.search(q, 10, probes).collect()}
    assert sum((i, j) in found for i in want for j in want[i]) >= 0.9 * 10 * len(want)


def test_postings_of_a_block_are_counted_in_one_pass():
    """Without a window or a list of one token's rows to sort: rows of one key are one document, a null key comes first, null texts hold nothing."""
    import pyarrow as pa

    docs, texts = pa.chunked_array([pa.array([7, None, 3], pa.int32()), pa.array([7, 9], pa.int32())]), pa.chunked_array([pa.array(["b a b", "a", "c_1 a"]), pa.array(["a é", None])])
    found, n, held, most = T.block_postings(docs, texts, 2.0)
    assert dict(zip(found, held.to_pylist())) == {
        "a": [{"doc": None, "tf": 1, "len": 1}, {"doc": 3, "tf": 1, "len": 2}, {"doc": 7, "tf": 2, "len": 4}], "b": [{"doc": 7, "tf": 2, "len": 4}], "c_1": [{"doc": 3, "tf": 1, "len": 2}]}
    assert dict(zip(found, n.tolist())) == {"a": 3, "b": 1, "c_1": 1} and held.type.value_type.field("doc").type == pa.int32()
    tf = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 2.0))
    assert dict(zip(found, most.round(9))) == {"a": round(max(tf(1, 1), tf(1, 2), tf(2, 4)), 9), "b": round(tf(2, 4), 9), "c_1": round(tf(1, 2), 9)}
