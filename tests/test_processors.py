"""File changes and idle timers: replayed over many micro-batches, across a restart, and with nothing left in state."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import processors as P

random.seed(6)


def run(spark, make, folder, at):
    """One run from where the checkpoint stands to the end of the input; the rows of all runs so far, and the rows left in state."""
    query = make(folder).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    left = sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])
    return spark.read.parquet(f"{at}/out"), left


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


SEEN = "path string, hash string, ts timestamp"


def changes_of(spark):
    return lambda folder: P.file_changes(spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts")), "5 seconds")


def scan(files, second, gone=()):
    import datetime

    t = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)
    return [(p, h, t) for p, h in files.items()] + [(p, None, t) for p in gone]


def test_changes_across_a_restart(spark, tmp_path):
    folder, at = f"file://{tmp_path}/in", f"file://{tmp_path}"
    one = {"a": "1", "b": "2", "c": "3", "d": "4", "e": "4"}
    two = {"a": "1", "b": "2b", "x/c": "3", "e": "4", "n": "9"}  # b modified, c moved, d deleted (its copy e stays), n created
    put(spark, scan(one, 0), SEEN, folder)
    put(spark, scan(one, 20), SEEN, folder)  # nothing new
    run(spark, changes_of(spark), folder, at)
    put(spark, scan(two, 40, ["c", "d"]), SEEN, folder)
    put(spark, scan({}, 60, ["b"]) + scan({"z": "77"}, 61), SEEN, folder)
    put(spark, scan({"end": "0"}, 999), SEEN, folder)
    put(spark, scan({"end": "0"}, 1999), SEEN, folder)
    out, _ = run(spark, changes_of(spark), folder, at)
    base = 1704067200 * 1_000_000
    got = sorted((int((r["us"] - base) // 1_000_000), r["kind"], r["path"], r["from_path"]) for r in out.collect() if r["path"] != "end")
    assert got == sorted([(0, "created", p, None) for p in one] + [(40, "modified", "b", None), (40, "moved", "x/c", "c"), (40, "deleted", "d", None), (40, "created", "n", None), (60, "deleted", "b", None), (61, "created", "z", None)], key=lambda r: (r[0], r[1], r[2], str(r[3])))


EVENT = "k long, ts timestamp, tick boolean"


@pytest.mark.parametrize("size", [None, 4])
def test_idle_batches_and_empty_state(spark, tmp_path, size):
    import datetime

    start, rows = datetime.datetime(2024, 1, 1), []
    for k in range(6):
        t = 0
        for _ in range(40):
            t += random.choice([1, 2, 5, 11, 10, 40])
            rows.append((k, start + datetime.timedelta(seconds=t), False))
    rows.sort(key=lambda r: r[1])
    folder, at = f"file://{tmp_path}/in", f"file://{tmp_path}"
    for i in range(0, len(rows), 60):
        put(spark, rows[i : i + 60], EVENT, folder)
    make = lambda f: P.until_idle(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f), "k", "10 seconds", size)
    run(spark, make, folder, at)
    put(spark, [(0, start + datetime.timedelta(days=9), True)], EVENT, folder)
    out, left = run(spark, make, folder, at)
    want, us = [], lambda t: int((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))
    for k in range(6):
        own, open_ = [us(t) for j, t, _ in rows if j == k], []
        for i, t in enumerate(own):
            if open_ and t - open_[-1] >= 10_000_000:
                want.append((k, open_[0], open_[-1], len(open_), "idle"))
                open_ = []
            open_.append(t)
            if size and len(open_) == size:
                want.append((k, open_[0], open_[-1], size, "full"))
                open_ = []
        if open_:
            want.append((k, open_[0], open_[-1], len(open_), "idle"))
    assert sorted(tuple(r) for r in out.select("key", "started_us", "ended_us", "n", "reason").collect()) == sorted(want)
    assert left == 0


def test_paths_share_the_keys_of_their_buckets(spark, tmp_path, monkeypatch):
    """Handlers are called and state is kept by bucket, not by path or content; moves pair by content within a bucket, over windows that end apart."""
    monkeypatch.setattr(P, "BUCKETS", 3)
    folder, at = f"file://{tmp_path}/in", f"file://{tmp_path}"
    one = {f"p{i:03}": f"h{i // 2}" for i in range(200)}
    put(spark, scan(one, 0), SEEN, folder)
    put(spark, scan({}, 20, [f"p{i:03}" for i in range(0, 60)]), SEEN, folder)
    put(spark, scan({f"q{i:03}": f"h{i // 2}" for i in range(0, 40)}, 22) + scan({"p100": "new"}, 23), SEEN, folder)
    put(spark, scan({"r1": "h25"}, 27), SEEN, folder)  # h25 went at 20: too long ago for a move
    for s in (999, 1999):
        put(spark, scan({"end": "0"}, s), SEEN, folder)
    out, left = run(spark, changes_of(spark), folder, at)
    got = sorted((r["kind"], r["path"], r["from_path"]) for r in out.collect() if r["path"] != "end")
    want = [("created", p, None) for p in one] + [("moved", f"q{i:03}", f"p{i:03}") for i in range(40)] + [("deleted", f"p{i:03}", None) for i in range(40, 60)]
    assert got == sorted(want + [("modified", "p100", None), ("created", "r1", None)], key=lambda r: (r[0], r[1]))
    assert left <= 3 * 2  # a row a bucket of paths, and no held change but the last observation's
