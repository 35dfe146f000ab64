"""Graph queries over all nodes, lines and files, on small tables with keys far apart, against plain Python."""

import collections
import random

import pytest

from tessera.plans import registry

WHOLE = registry.queries()
random.seed(11)
PARTS = [(p, f"name {p}", p % 50) for p in (*range(1, 20), *range(290, 320), 5000, 5001)]
LINES = [(o, n, random.choice(PARTS[:-1])[0], random.randint(1, 6), random.randint(1, 50)) for o in range(60) for n in range(1, random.randint(2, 6))]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_size long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{d}/lineitem.parquet")
    return d


def edges():
    imp = {(a[2], b[2]) for a in LINES for b in LINES if a[0] == b[0] and b[1] > a[1] and a[2] != b[2]}
    return imp, {(x[3], x[2]) for x in LINES}


def test_contexts_of_every_part(spark, small):
    imp, sup = edges()
    by, of, held = (collections.Counter(x) for x in ([d for _, d in imp], [s for s, _ in imp], [d for _, d in sup]))
    want = sorted((p, by[p], of[p], held[p]) for p, _, _ in PARTS)
    assert sorted(map(tuple, WHOLE["graph_context"](spark, small).collect())) == want
    assert sorted(r["node"] for r in WHOLE["graph_boost"](spark, small).collect()) == [p for p, _, _ in PARTS]
    said = {r["node"]: r["summary"] for r in WHOLE["context_summary"](spark, small).collect()}
    assert said == {p: f"part {p}: imported by {a}, imports {b}" + (f", suppliers {c}" if c else "") for p, a, b, c in want}


def test_lists_and_providers_of_every_part(spark, small):
    imp, _ = edges()
    got = {r["node"]: r["first_importers"] for r in WHOLE["context_lists"](spark, small).collect()}
    assert got == {p: sorted(s for s, d in imp if d == p)[:5] for _, p in imp} and max(got) > 100
    name = {p: n for p, n, size in PARTS if size > 25}
    got = {r["src"]: r["providers"] for r in WHOLE["provider_join"](spark, small).collect()}
    assert got == {p: sorted({name.get(d, f"module-{d}") for s, d in imp if s == p}) for p, _ in imp} and max(got) > 50


def test_spans_of_every_file(spark, tmp_path):
    orders = [(o, 1 + o % 7) for o in (*range(120), *range(400, 520))]
    spark.createDataFrame([(i,) for i in range(1, 9)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {k: sorted(map(tuple, WHOLE[k](spark, str(tmp_path)).collect())) for k in ("range_containment", "point_in_interval", "call_edges")}
    assert got["range_containment"] == sorted((f, o % 400 // 50, o) for o, f in orders if o % 50 + 15 <= 49)
    at = collections.defaultdict(list)
    for o, f in orders:
        at[f, o % 400 // 50].append(o)
    assert got["point_in_interval"] == sorted((*k, len(v), min(v)) for k, v in at.items())
    assert got["call_edges"] == sorted({(f, o % 400 // 50, p) for o, f in orders for p, g in orders if g == f + 1 and p % 400 == o % 400})
    assert {r[0] for r in got["range_containment"]} == set(range(1, 8))
