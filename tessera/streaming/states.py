"""State machines whose next answer depends on the answers before: cooldown, rate limits, circuit breaker.

Each is a pure step (state, time, event) -> (state, answer), run per key by ``applyInPandasWithState`` over a stream; state is small and bounded.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[tuple, float, str], tuple[tuple, str]]


def cooldown(seconds: float) -> Step:
    """Ignore what comes within ``seconds`` of the last accepted event."""

    def step(state, t, _):
        if state and t - state[0] < seconds:
            return state, "ignored"
        return (t,), "accepted"

    return step


def sliding_limit(limit: int, seconds: float) -> Step:
    """Allow below ``limit`` accepted events in the last ``seconds``; rejected ones do not count."""

    def step(state, t, _):
        state = tuple(x for x in state if x > t - seconds)
        return (state, "rejected") if len(state) >= limit else (state + (t,), "allowed")

    return step


def fixed_limit(limit: int, seconds: float) -> Step:
    """Windows that begin at the first event after the last one ended."""

    def step(state, t, _):
        start, n = state or (t, 0.0)
        if t - start >= seconds:
            start, n = t, 0.0
        return ((start, n), "rejected") if n >= limit else ((start, n + 1), "allowed")

    return step


def breaker(failures: int, recovery: float, failed: str = "error") -> Step:
    """closed, open (2.0 after failures in a row), half open after ``recovery`` seconds: (mode, count or time)."""

    def step(state, t, kind):
        mode, x = state or (0.0, 0.0)
        if mode == 2.0 and t - x >= recovery:
            mode = 1.0
        if mode == 2.0:
            return (mode, x), "open"
        if kind == failed:
            x = x + 1 if mode == 0.0 else failures
            return ((2.0, t), "open") if x >= failures else ((0.0, x), "closed")
        return (0.0, 0.0), "closed"

    return step


def replay(rows: Iterator[tuple], step: Step, state: tuple = ()) -> tuple[tuple, list[str]]:
    out = []
    for t, kind in rows:
        state, answer = step(state, t, kind)
        out.append(answer)
    return state, out


def stateful(events: DataFrame, key: str, step: Step) -> DataFrame:
    """(event_id, key, answer) of a stream of ``events(event_id, key, ts, event_type)``; events of a batch are taken in time order."""

    def run(k, frames, state):
        pdf = pd.concat(list(frames)).sort_values(["t", "event_id"])
        now = tuple(state.get[0]) if state.exists else ()
        now, answers = replay(zip(pdf["t"], pdf["event_type"]), step, now)
        state.update((list(now),))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), key: k[0], "answer": answers})

    kind = dict(events.dtypes)[key]
    e = events.select("event_id", key, "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return e.groupBy(key).applyInPandasWithState(run, f"event_id long, {key} {kind}, answer string", "s array<double>", "append", "NoTimeout")
