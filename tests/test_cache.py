"""Results kept for a time."""

import pytest

from tessera.sources.cache import ResultCache


@pytest.fixture
def cache(spark):
    now = [0.0]
    c = ResultCache(spark, ttl=10, most=2, grace=1, clock=lambda: now[0])
    c.now, c.made = now, []
    return c


def ask(c, key, n):
    def make():
        c.made.append(key)
        return c.spark.range(n)

    return c.get((key,), make)


def test_age_and_number(cache):
    assert ask(cache, "a", 3).count() == 3 and ask(cache, "a", 99).count() == 3 and cache.made == ["a"]
    cache.now[0] = 11
    assert ask(cache, "a", 4).count() == 4 and cache.expired == 1
    ask(cache, "b", 1)
    ask(cache, "a", 0)
    ask(cache, "c", 1)  # b was used longest ago
    assert cache.evicted == 1 and list(cache.held) == [("a",), ("c",)]
    assert ask(cache, "a", 0).count() == 4 and ask(cache, "b", 7).count() == 7
    assert (cache.hits, cache.misses) == (3, 5)


def test_a_dropped_result_is_read_to_the_end(cache):
    held = ask(cache, "a", 5)
    for k in "bc":
        ask(cache, k, 1)
    assert held.count() == 5 and len(cache.gone) == 1
    for k in "de":
        ask(cache, k, 1)
    assert len(cache.gone) == 1
