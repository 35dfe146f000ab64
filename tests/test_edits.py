"""Edit scripts are scripts, and shortest; chunks around them equal chunking from scratch."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import edits as E

LINES = st.lists(st.sampled_from(["a", "b", "c", "dd", ""]), max_size=14)


def size(hunks):
    return sum(b - a + d - c for a, b, c, d in hunks)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_shortest_script(a, b):
    hunks = E.script(a, b)
    assert E.applied(a, [(h, b[h[2] : h[3]]) for h in hunks]) == b
    assert size(hunks) == len(a) + len(b) - 2 * lcs(a, b)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES, st.integers(2, 9))
def test_chunks_equal_chunking_from_scratch(a, b, limit):
    got = E.rechunked(E.chunked(a, limit), E.script(a, b), b, limit)
    assert [e for _, e, _ in got] == E.chunked(b, limit) and [s for s, _, _ in got] == [0, *(e for _, e, _ in got)][:-1][: len(got)]


def test_one_edit_touches_few_chunks():
    random.seed(1)
    old = ["x" * random.randint(1, 60) for _ in range(4000)]
    new = old[:2000] + ["put in"] + old[2001:]
    got = E.rechunked(E.chunked(old, 400), E.script(old, new), new, 400)
    assert [e for _, e, _ in got] == E.chunked(new, 400)
    assert sum(not kept for _, _, kept in got) < 40


def test_many_edits_are_one_hunk():
    old, new = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(70)]
    assert E.script(["h", *old, "t"], ["h", *new, "t"], 10) == [(1, 61, 1, 71)]


def test_frames(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "same", "same"), (4, "", "\n"), (5, "long\n" * 5000, "long\n" * 2500 + "new\n" + "long\n" * 2500)]
    df = spark.createDataFrame(rows, "k long, old string, new string")
    scripts = E.edit_scripts(df, "k")
    assert sorted((r["k"], r["a"], r["b"], r["c"], r["d"], r["put"]) for r in scripts.where("k < 4").collect()) == [(1, 1, 2, 1, 1, []), (1, 3, 3, 2, 3, ["d"]), (2, 0, 0, 0, 1, ["x"])]
    got = {r["k"]: r["new"] for r in E.apply_scripts(df.where("old is not null").select("k", "old"), scripts, "k").collect()}
    assert got == {k: n for k, o, n in rows if o is not None}
    assert E.edit_scripts(df.limit(0), "k").count() == 0 and E.rechunk(df.limit(0), "k", 10).count() == 0


@pytest.mark.parametrize("limit", [20, 400])
def test_query_of_chunks(spark, sf, limit):
    from tessera.plans import corpus

    d = corpus.edited(spark, sf).limit(60).cache()
    got = {}
    for r in E.rechunk(d, "doc_id", limit).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for r in d.collect():
        assert [e for _, e in sorted(got.get(r["doc_id"], []))] == E.chunked(r["new"].split("\n"), limit)
