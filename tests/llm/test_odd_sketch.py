"""Operator 12 against all pairs, on copies, near copies, a dense group and awkward rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import odd_sketch as O
from tessera.llm.textkernel import Block, blocks, lowered

random.seed(8)
WORDS = [f"w{i}" for i in range(400)] + ["Éa", "ABC", "x y"]
make = lambda n: [random.choice(WORDS) for _ in range(n)]


def edited(words, n):
    out = list(words)
    for i in random.sample(range(len(out)), n):
        out[i] = random.choice(WORDS)
    return out


def awkward():
    base, dense = [make(random.randint(30, 300)) for _ in range(12)], make(120)
    out = [(i, " ".join(base[i])) for i in range(12)]
    out += [(20 + i, " ".join(edited(base[i % 12], 1 + i % 3))) for i in range(36)]
    out += [(100 + i, " ".join(edited(dense, random.randint(1, 3)))) for i in range(90)]  # some pairs above, some below the threshold
    long = make(3000)
    out += [(300, " ".join(long)), (301, " ".join(edited(long, 30))), (302, " ".join(edited(long, 200))), (303, "\n".join(long).upper().replace("É", "É"))]
    out += [(310, None), (311, ""), (312, " \t\n"), (313, "one two"), (314, "One  two\n"), (315, "one two three four five"), (316, "two one"), (317, "w " * 50_000), (318, "w " * 70)]
    out += [(None, out[3][1]), (None, "unlike any other text that is here"), (5, out[5][1]), (7, "the id seven again with words of its own"), (-4, " ".join(edited(base[2], 1)))]
    return out


def brute(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    out = [(d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=str)


@pytest.mark.parametrize("few", [O.MAX_BROADCAST, 0])
def test_same_as_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(O, "MAX_BROADCAST", few)
    rows = awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"rid": F.lit("clash"), "n": F.lit(1), "key": F.lit(None), "comp": F.lit(2)})
    want = brute(rows)
    assert sum(not r[3] for r in want) > 40 and sorted(map(tuple, O.near_duplicates(df).collect()), key=str) == want


def test_empty_tables(spark):
    assert O.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sorted(map(tuple, O.near_duplicates(spark.createDataFrame([(3, None), (1, "")], "doc_id long, text string")).collect())) == [(1, 0, 1, True), (3, 0, 3, True)]


def test_query_same_as_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, O.query(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [100, 500, 900, 4000])
def test_sketches_keep_pairs_at_the_threshold(spark, size):
    """Sets at a similarity of 0.85 stay within the bound, pairs far below do not."""
    rng, cut = np.random.default_rng(1), {}
    for share in (0.85, 0.45):
        same = math.ceil(2 * size * share / (1 + share))
        pairs, ones = [], []
        for _ in range(200):
            h = np.unique(rng.integers(0, 1 << 63, 2 * size - same, np.uint64))
            a, b = np.sort(h[rng.permutation(len(h))][:size]), None
            rest = np.setdiff1d(h, a)
            b = np.sort(np.append(rng.permutation(a)[:same], rest))
            s = O.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            ones.append(int(sum(int(x).bit_count() for x in (s[0] ^ s[1]).view(np.uint64))))
            pairs.append((len(a), len(b)))
        bound = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(O.most_ones(F.col("a"), F.col("b"), 0.85)).collect()]
        cut[share] = sum(o <= m for o, m in zip(ones, bound))
    assert cut[0.85] == 200 and cut[0.45] <= 10


def test_sets_of_blocks_of_any_size():
    texts = ["a b c d e f a b c d e", "", None, "x y", "A b C", "é ü"]
    for limit in (1, 12, 1 << 20):
        got = []
        for b in blocks(pa.array(texts), limit=limit):
            h, off = O.sets(Block(lowered(b.data), b.off, b.first))
            got += [h[i:j].tolist() for i, j in zip(off, off[1:])]
        assert [len(x) for x in got] == [6, 0, 0, 1, 1, 1]
    assert O.sets(Block(np.frombuffer(b"x yx y", np.uint8), np.array([0, 3, 6]), 0))[0].tolist()[0] == O.sets(Block(np.frombuffer(b"x yx y", np.uint8), np.array([0, 3, 6]), 0))[0].tolist()[1]


def test_rows_of_bands_are_dealt_once_and_sets_read_before_stay(spark, monkeypatch):
    """Buckets are grouped and joined on one exchange of lists that have met their class; a pass moves the whole sets of its own pairs only."""
    plans, real = {}, O.work_table

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(O, "work_table", kept)
    rows = awkward()
    assert sorted(map(tuple, O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str) == brute(rows)
    assert len(plans["buckets"]) == 1 + len(O.PASSES) and all("RepartitionByExpression [key" in p for p in plans["buckets"])
    assert len(plans["links"]) == 1 + len(O.PASSES) and all("LeftSemi" in p for p in plans["links"])
