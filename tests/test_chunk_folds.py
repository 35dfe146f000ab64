"""The chunkers against plain folds."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking as C
from tessera.plans import registry


def fold(costs, limit, overlap, ends):
    """One item at a time: the next range takes at least one new item, stops before its limit breaks, or at a mark once over half full."""
    out, start, stop = [], 0, 0
    while stop < len(costs):
        end, used = start, 0
        while end < len(costs) and (end < stop + 1 or used + costs[end] <= limit):
            used += costs[end]
            end += 1
            if end >= stop + 1 and end < len(costs) and end in ends and used > limit // 2:
                break
        out.append((start, end))
        stop, start = end, end - overlap(end - start)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(5, 80), st.sets(st.integers(0, 40)), st.integers(0, 3))
def test_ranges(costs, limit, marks, again):
    ends = sorted(m for m in marks if 0 < m < len(costs))
    overlap = lambda n: min(again, n // 2)
    assert list(C.ranges(costs, limit, overlap, ends)) == fold(costs, limit, overlap, set(ends))


def test_merge_and_split():
    small = [(1, 1, "a", "", "x" * 40), (2, 2, "a", "n", "y" * 40), (3, 3, "a", "", "z" * 40), (4, 4, "b", "", "w"), (5, 5, "b", "", "v" * 500)]
    assert [(c[0], c[1], c[2], c[3], len(c[4])) for c in C.merge_small(small)] == [(1, 3, "a", "n", 122), (4, 5, "b", "", 502)]
    text = "\n".join("line %d of a long definition" % i for i in range(400))
    parts = C.split_large([(11, 410, "function", "f", text)], 2000)
    assert parts[0][0] == 11 and parts[-1][1] == 410 and all(len(p[4]) <= 4 * (C.MAX_TOKENS + p[1] - p[0] + 1) and p[2:4] == ("function", "f") for p in parts)
    assert all(b[0] <= a[1] + 1 for a, b in zip(parts, parts[1:]))  # nothing is left out


def test_every_branch_of_the_dispatcher(spark, sf):
    got = registry.queries()["text_chunks"](spark, sf)
    kinds = {r[0] for r in got.select("kind").distinct().collect()}
    assert {"whole", "code", "text", "class", "function"} <= kinds
    one = got.where("doc_id = -2").orderBy("start_line").collect()
    assert [(r["kind"], r["name"]) for r in one][:1] == [("class", "Item2")] and {r["name"] for r in one} >= {"Item2", "build_2"}


def test_text_that_overflows_the_parser(spark):
    """Prose whose nesting is beyond the parser's stack is no source; it is cut by lines."""
    deep = "- " * 20_000 + "x\n" + "plain words here\n" * 100
    assert list(C.python_chunks(deep)) == [] and C.ast_complexity(deep) is None
    got = C.chunked(spark.createDataFrame([(1, deep, "py")], "doc_id long, text string, suffix string"), "doc_id", "suffix").collect()
    assert got and {r["kind"] for r in got} == {"code"}
