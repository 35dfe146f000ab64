"""Interval and as-of joins, typed traversal, sketches, hash trees and name resolution against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import hash_tree as H
from tessera.operators import intervals as I
from tessera.operators import resolve as N

random.seed(3)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_interval_joins_same_as_all_pairs(spark):
    span = lambda n: [(random.choice("ab"), i, s := random.randint(-40, 200), s + random.randint(-2, 60)) for i in range(n)]
    left, right = span(60) + [(None, 98, 1, 5), ("a", 99, None, 5)], span(50) + [("a", 77, 5, None)]
    a = spark.createDataFrame(left, "k string, i int, s long, e long")
    b = spark.createDataFrame(right, "k string, j int, cs long, ce long")
    ok = lambda *x: all(v is not None for v in x)
    for width in (1, 13, 500):
        got = I.holding(a, b, ["k"], "s", "cs", "ce", width).select("i", "j")
        assert tuples(got) == sorted(((i, j) for k, i, s, _ in left for q, j, x, y in right if ok(k, s, x, y) and k == q and x <= s <= y), key=str)
        got = I.overlapping(a, b, ["k"], ("s", "e"), ("cs", "ce"), width).select("i", "j")
        assert tuples(got) == sorted(((i, j) for k, i, s, e in left for q, j, x, y in right if ok(k, s, e, x, y) and k == q and s <= e and x <= y and s <= y and x <= e), key=str)


def test_one_file_of_many_symbols(spark):
    """100,000 symbols and 10,000 chunks of one file: rows of the join follow the matches, not the product."""
    symbols = spark.range(100_000).select(F.lit("f").alias("file"), F.col("id").alias("sym"), (F.col("id") * 5).alias("s"))
    chunks = spark.range(10_000).select(F.lit("f").alias("file"), F.col("id").alias("chunk"), (F.col("id") * 50).alias("cs"), (F.col("id") * 50 + 49).alias("ce"))
    met = I.holding(symbols, chunks, ["file"], "s", "cs", "ce", 50)
    assert met.count() == 100_000
    in_bins = symbols.groupBy(F.floor(F.col("s") / 50)).count().agg(F.max("count")).first()[0]
    assert in_bins == 10  # what a bin of one file holds, whatever the file's size
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "__bin" in plan.split("Join")[1].split("\n")[0] and "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_same_as_scan(spark):
    left = [(random.choice(["x", "y", None]), i, random.choice([None, *range(0, 400)])) for i in range(200)]
    right = [(random.choice(["x", "x", "x", "y"]), random.randint(0, 400), random.randint(0, 9)) for _ in range(80)] + [("x", None, 5), ("y", 10, None)]
    a = spark.createDataFrame(left, "k string, id int, at long")
    b = spark.createDataFrame(right, "k string, w long, v int")
    low = lambda v: -1 if v is None else v
    want = []
    for k, i, at in left:
        fit = [(w, low(v), v) for q, w, v in right if k is not None and at is not None and q == k and w is not None and w <= at]
        want.append((k, i, at, max(fit)[2] if fit else None))
    for span in (1, 50, 10_000):
        assert tuples(I.as_of(a, b, ["k"], "at", "w", ["v"], span)) == sorted(want, key=str)


def test_typed_traversal(spark):
    edges = [("I", 1, 2), ("I", 2, 3), ("S", 9, 2), ("I", 3, 1), ("S", 8, 3), ("I", 3, 4), ("I", 3, 4)]
    e, s = spark.createDataFrame(edges, "rel string, src long, dst long"), spark.createDataFrame([(1,)], "node long")
    got = lambda *a: sorted(tuple(r)[1:] for r in G.reach(e, s, *a).collect())
    assert got(2) == [(2, 1), (3, 2)]
    assert got(4) == [(1, 3), (2, 1), (3, 2), (4, 3)]
    assert got(1, ["S"]) == [] and got(2, ["I"], "in") == [(2, 2), (3, 1)]
    assert got(2, ["I", "S"], "both") == [(1, 2), (2, 1), (3, 1), (4, 2), (8, 2), (9, 2)]


def test_sketches_of_all_nodes(spark):
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(900)]
    step = collections.defaultdict(set)
    for a, b in edges:
        step[a].add(b)
    want = {}
    for a in step:
        seen, front = set(), {a}
        for _ in range(3):
            front = set().union(*(step.get(x, set()) for x in front))
            seen |= front
        want[a] = len(seen)
    got = {r["node"]: r["reached"] for r in G.reach_sizes(spark.createDataFrame(edges, "src long, dst long"), 3).collect()}
    assert set(got) == set(want) and all(abs(got[a] - want[a]) <= 4 * G.SKETCH_ERROR * want[a] + 0.5 for a in want)
    assert sum(got[a] == want[a] for a in want if want[a] <= 8) == sum(want[a] <= 8 for a in want)


FILES = "path string, lines long, size long, language string, modified long"


def versions():
    old = [(f"p{a}/d{b}/e{c}/f{i}.py", i, 10 * i, "py" if i % 2 else None, i) for a in range(3) for b in range(4) for c in range(2) for i in range(3)] + [("top.py", 1, 1, "py", 1), (None, 1, 1, "py", 1)]
    new = [r for r in old if not (r[0] or "").startswith("p1/d2")]
    new = [(p, n, s + 1, x, m) if p == "p1/d0/e1/f2.py" else (p, n, s, x, m) for p, n, s, x, m in new] + [("p1/new/deep/f.py", 1, 1, "go", 9)]
    return old, new


def flat(rows):
    own = collections.defaultdict(list)
    for p, n, s, x, m in rows:
        if p is not None:
            parts = p.split("/")[:-1]
            for i in range(len(parts) + 1):
                own["/".join(parts[:i])] += [(n, s, x, m)] if i == len(parts) else []
    return {d: (len(v), sum(r[0] for r in v), sum(r[1] for r in v), sorted({r[2] for r in v if r[2]}), max([r[3] for r in v], default=0)) for d, v in own.items()}


@pytest.mark.parametrize("under", ["", "p1", "p0/d1"])
def test_changed_directories_and_what_is_read(spark, under):
    old, new = versions()
    a, b = flat(old), flat(new)
    want = sorted((d, "added" if d not in a else "deleted" if d not in b else "modified") for d in {*a, *b} if a.get(d) != b.get(d) and (not under or (d + "/").startswith(under + "/")))
    met = []
    x, y = (H.tree(spark.createDataFrame(r, FILES).repartition(3)) for r in (old, new))
    assert sorted(map(tuple, H.differing(x, y, under, met).collect())) == want
    assert x.where("dir = 'p0'").first()["hash"] == y.where("dir = 'p0'").first()["hash"]
    assert [n for n in met if n] == {"": [1, 3, 5, 5], "p1": [1, 5, 5], "p0/d1": [1]}[under]  # p0 and p2 are equal: nothing below them is met


def test_trees_of_nothing(spark):
    none = H.tree(spark.createDataFrame([], FILES))
    some = H.tree(spark.createDataFrame([("a/b.py", 1, 1, "py", 1)], FILES))
    assert none.count() == 0 and H.differing(none, none).count() == 0
    assert sorted(map(tuple, H.differing(none, some).collect())) == [("", "added"), ("a", "added")]


SOURCES = {
    "a": "import lib.x as m\nfrom lib.y import f as g, h\nfrom lib.y import f as g\n\n@deco\ndef top(n):\n    m.run(g(n))\n    return shared()\n\nclass K(Base):\n    def one(self):\n        return self.two() + self.gone()\n\n    async def two(self):\n        shared()\n        obj.one()\n\ntop(1)",
    "lib.x": "def run(v):\n    def inner():\n        run(v)\n    return inner()",
    "lib.y": "def f(v):\n    return v\n\ndef shared():\n    if f(1): pass",
    "b": "def broken(:\n  ]]\ndef shared():\n    nowhere()  # not(a) call(b)\n",
    "c": None,
}


def test_calls_and_imports_by_hand(spark):
    s = spark.createDataFrame(list(SOURCES.items()), "module string, source string")
    parsed = N.lines(s)
    assert tuples(N.import_edges(parsed, s)) == [("a", "lib.x", True), ("a", "lib.y", True)]
    got = {(m, c, f, x): set() for m, c, f, x, *_ in map(tuple, N.call_edges(parsed).collect())}
    for m, c, f, x, *to in map(tuple, N.call_edges(parsed).collect()):
        got[m, c, f, x].add(tuple(to))
    both = {("lib.y", "", "shared", "project"), ("b", "", "shared", "project")}
    none = {(None, None, None, "unresolved")}
    assert got == {
        ("a", "", "top", "m.run"): {("lib.x", "", "run", "import")}, ("a", "", "top", "g"): {("lib.y", "", "f", "import")}, ("a", "", "top", "shared"): both,
        ("a", "K", "one", "self.two"): {("a", "K", "two", "own")}, ("a", "K", "one", "self.gone"): none, ("a", "K", "two", "shared"): both, ("a", "K", "two", "obj.one"): {("a", "K", "one", "project")},
        ("a", "", "", "top"): {("a", "", "top", "own")}, ("lib.x", "", "run", "run"): {("lib.x", "", "run", "own")}, ("lib.x", "", "run", "inner"): none,
        ("lib.y", "", "shared", "f"): {("lib.y", "", "f", "own")}, ("b", "", "shared", "nowhere"): none,
    }


def test_a_name_of_many_modules_is_salted(spark, monkeypatch):
    monkeypatch.setattr(N, "SALTED", 3)
    s = spark.range(20).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("module"), F.when(F.col("id") < 15, "def get():\n    pass").otherwise("def ask():\n    get()").alias("source"))
    assert N.call_edges(N.lines(s)).where("how = 'project'").count() == 15 * 5


def test_facts_are_joined_in_tasks_only(spark):
    """Facts look small beside what they are cut from, so size alone would send those of a whole project to the driver; calls that no import fits are spread."""
    s = spark.createDataFrame(list(SOURCES.items()), "module string, source string")
    plan = N.call_edges(N.lines(s))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate posexplode" not in plan and "SortMergeJoin [at#" in plan
