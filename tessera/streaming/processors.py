"""Keyed processors with event-time timers: file changes by bucket, and batches or sessions that end when idle.

All state has an end: a session's state goes when its timer fires, a deleted path goes from its bucket's state with the deletion, a held change goes when its window is over.  Times are event times, so results do
not depend on how the input falls into micro-batches, as long as rows are no later than the watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _all(frames, *order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(order))


#: Keys that paths and content hashes are dealt over: a handler is called once a bucket and batch, however many paths there are.
BUCKETS = 4096


def bucket(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


class PathState(StatefulProcessor):
    """The last content hash of each path of a bucket; a change row when an observation differs from it.  A null hash means that the path is gone."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "paths array<string>, hashes array<string>")

    def handleInputRows(self, key, rows, timerValues):
        now = dict(zip(*self.last.get())) if self.last.exists() else {}
        was, out = dict(now), []
        for path, us, h in _all(rows, "us", "hash")[["path", "us", "hash"]].itertuples(index=False, name=None):
            path, h = (None if pd.isna(x) else x for x in (path, h))
            old = now.get(path)
            if h == old:
                continue
            out.append((path, "created" if old is None else "deleted" if h is None else "modified", h or old, us))
            if h is None:
                del now[path]
            else:
                now[path] = h
        if not now:
            self.last.clear()
        elif now != was:
            self.last.update((list(now), list(now.values())))
        if out:
            d = pd.DataFrame(out, columns=["path", "kind", "hash", "us"])
            yield d.assign(ts=pd.to_datetime(d["us"], unit="us"))

    def close(self) -> None:
        pass


class Moves(StatefulProcessor):
    """Holds the deletions and creations of a bucket of content hashes for ``window`` microseconds; a creation and a deletion of one hash that meet are one move.

    The k-th path deleted and the k-th created of a hash, by time and path, belong together.  A timer of one hash finds nothing due of another, whose own timers come first.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "hash string, path string, kind string, us long")

    def handleInputRows(self, key, rows, timerValues):
        d = _all(rows, "us", "path")
        changed = d[d["kind"] == "modified"]
        if len(changed):
            yield changed.assign(from_path=None)[OUT]
        rest = d[d["kind"] != "modified"]
        if len(rest):
            self.held.appendList(list(rest[["hash", "path", "kind", "us"]].itertuples(index=False, name=None)))
            for us in rest["us"].unique():
                self.handle.registerTimer(-(-(int(us) + self.window) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.window
        by, out, left = {}, [], []
        for h, *r in self.held.get():
            by.setdefault(h, []).append(tuple(r))
        for h, held in by.items():
            found, rest = self.due(sorted(held, key=lambda r: (r[2], r[0])), upto)
            out += [(path, origin, kind, h, us) for path, origin, kind, us in found]
            left += [(h, *r) for r in rest]
        self.held.put(left) if left else self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=OUT)

    def due(self, held: list, upto: int) -> tuple[list, list]:
        """(path, from_path, kind, us) of what leaves of one hash, and what stays held."""
        old = [r for r in held if r[2] <= upto]
        gone, made = ([r for r in held if r[1] == k] for k in ("deleted", "created"))
        # a change leaves when its own window is over, or with its partner's
        met = [(g, m) for g, m in zip(gone, made) if min(g[2], m[2]) <= upto and abs(g[2] - m[2]) <= self.window]
        used = {id(r) for p in met for r in p}
        alone = [r for r in old if id(r) not in used]
        return [(m[0], g[0], "moved", m[2]) for g, m in met] + [(r[0], None, r[1], r[2]) for r in alone], [r for r in held if id(r) not in used and r[2] > upto]

    def close(self) -> None:
        pass


OUT = ["path", "from_path", "kind", "hash", "us"]


def file_changes(observed: DataFrame, window: str = "1 second", late: str = "0 seconds") -> DataFrame:
    """(path, from_path, kind, hash, us) of a stream of ``observed(path, hash, ts)``: created, modified, deleted and moved, each once."""
    observed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    micros = int(pd.Timedelta(window) / pd.Timedelta("1us"))
    seen = observed.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    changes = seen.withColumn("bucket", bucket("path")).groupBy("bucket").transformWithStateInPandas(PathState(), "path string, kind string, hash string, us long, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts")
    return changes.withColumn("bucket", bucket("hash")).groupBy("bucket").transformWithStateInPandas(Moves(micros), "path string, from_path string, kind string, hash string, us long", "Append", "EventTime")


class Idle(StatefulProcessor):
    """Rows of a key are held together until ``size`` are there (if set) or none has come for ``gap`` microseconds."""

    def __init__(self, gap: int, size: int | None):
        self.gap, self.size = gap, size

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        now, out = tuple(self.open.get()) if self.open.exists() else None, []
        if now:
            self.handle.deleteTimer(self.due(now))
        for us in _all(rows, "us")["us"]:
            if us < 0:  # the row has moved time on; a filter would take it from below the watermark
                continue
            if now and us - now[1] >= self.gap:
                out.append((*now, "idle"))
                now = None
            now = (now[0] if now else us, us, (now[2] if now else 0) + 1)
            if self.size and now[2] == self.size:
                out.append((*now, "full"))
                now = None
        if now:
            self.open.update(tuple(int(x) for x in now))
            self.handle.registerTimer(self.due(now))
        else:
            self.open.clear()
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.open.exists():
            now = tuple(self.open.get())
            self.open.clear()
            yield self.frame(key, [(*now, "idle")])

    def due(self, now) -> int:
        return -(-(int(now[1]) + self.gap) // 1000)

    def frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["key", "started_us", "ended_us", "n", "reason"])

    def close(self) -> None:
        pass


def until_idle(events: DataFrame, key: str, gap: str, size: int | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, started_us, ended_us, n, reason) of each batch or session of a stream of ``events(key, ts, tick)``; rows that tick only move time on."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(events.dtypes)[key]
    timed = events.withWatermark("ts", late).withColumn("us", F.when(F.col("tick"), -1).otherwise(F.unix_micros("ts"))).select(F.col(key).alias("key"), "ts", "us")
    return timed.groupBy("key").transformWithStateInPandas(Idle(int(pd.Timedelta(gap) / pd.Timedelta("1us")), size), f"key {kind}, started_us long, ended_us long, n long, reason string", "Append", "EventTime")
