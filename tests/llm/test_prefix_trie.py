"""Operator 11 against brute force, with deep shared prefixes, hot turns and awkward rows."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import same_as_sql
from tessera.llm import prefix_trie
from tessera.operators.numbering import numbered

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    orig = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            orig[c].append(((t is not None, t or 0), r or "", x or ""))
    orig = {c: [(r, x) for _, r, x in sorted(v)] for c, v in orig.items()}
    again = {c: orig.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in orig.items()}
    nodes = collections.defaultdict(list)
    for c, v in again.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in nodes if k), collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode().split()) if k else 0
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(again[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(k, m)) for k, m in nodes.items()), key=lambda r: r[:2])


def awkward():
    out = []
    for c in range(60):  # copies of one conversation, some cut short
        out += [(c * 7, t, "user" if t % 2 else "bot", f"turn {t % 5} of all") for t in range(3 + c % 9)]
    for c in range(900, 906):  # equal for 13 turns
        out += [(c, t, "user", f"deep {t}") for t in range(13 if c < 904 else 11)] + [(c, 50, "bot", f"end {c % 2}")]
    out += [(1000, None, None, None), (1000, 1, "user", "later"), (1000, 1, "user", "later"), (1000, 1, "bot", "tied"), (1001, 5, "a", "b c"), (1002, 5, "a:b", " c"), (None, 0, "user", "no id")]
    out += [(1003, 0, "user", ""), (1004, 0, None, "word " * 200_000), (-45, 0, "user", "negative"), (-45, 1, "user", "id"), (-40, 0, "user", "base"), (7, 99, "user", "no base here\u0085x")]
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def test_same_as_brute_force(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"c": F.lit("clash"), "node": F.lit(1), "d": F.lit(None)})
    assert got(prefix_trie.prefix_trie(df)) == brute(rows)


@pytest.mark.parametrize("single, widest", [(1, 2), (2, 256)])
def test_bands_of_any_width_agree(spark, monkeypatch, single, widest):
    rows = [r for r in awkward() if r[0] is not None and 900 <= r[0] < 1000]
    monkeypatch.setattr(prefix_trie, "SINGLE", single)
    monkeypatch.setattr(prefix_trie, "WIDEST", widest)
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(5, 1, "a", "b c")], [(4, None, None, None), (24, 1, None, None)]])
def test_few_rows(spark, rows):
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ends_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 10)
    df = spark.range(1000).select(F.lit(3).cast("long").alias("conv_id"), F.lit(2).cast("long").alias("depth"), (F.col("id") * 37 % 1000).alias("c")).union(spark.createDataFrame([(1, 1, -4)], "a long, b long, c long"))
    want = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert got(prefix_trie.ends_hash(df)) == [(1, 1, hashlib.sha256(b"-4").hexdigest()), (3, 2, want)]


def test_numbers_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 4).alias("k"), (F.col("id") * 7919 % 5000).alias("o"), F.lit("x").alias("v")).union(spark.createDataFrame([(None, 1, "x"), (None, 0, "y")], "k long, o long, v string"))
    rows = numbered(df.repartition(6), ["k"], ["o"], ["o", "v"]).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["k"]].append((r["o"], r["n"]))
    assert len(rows) == 5002 and all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_query_and_sql(spark, duck, sf):
    same_as_sql(prefix_trie.query(spark, sf), duck, prefix_trie.SQL)
