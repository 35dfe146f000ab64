import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.sources import files as S
from tessera.sources import sinks as K
from tessera.streaming import states as A


def test_file_scan(spark, tmp_path):
    for name, text in {"p/a.py": "x", "p/node_modules/b.py": "x", "q/c.bin": "x", "q/d.md": "y" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = S.file_scan(spark, f"file:{tmp_path}", max_bytes=40)
    assert [r["path"].rsplit("/", 1)[1] for r in got.collect()] == ["a.py"]
    assert [r["project"] for r in S.projects(got, str(tmp_path)).collect()] == ["p"]


def test_rules_config_and_log(spark, tmp_path):
    (tmp_path / "rules").write_text("# c\n*/x/*\n!deprioritize:*.md,0.5\n")
    assert S.rule_file(spark, str(tmp_path / "rules")).count() == 2
    got = S.canon_config(json.dumps({"primary": ["a/*"], "deprecated": [{"pattern": "b/*", "weight": 0.2}]}))
    assert got == [("a/*", "primary", 1.0), ("b/*", "deprecated", 0.2)]
    (tmp_path / "log").write_text("aaaaaaaaaa|x@y|1700000000|f\nbbbbbbbbbb|z@y|1700100000|f\n")
    r = S.git_metrics(S.git_log(spark, str(tmp_path / "log")), F.timestamp_seconds(F.lit(1702000000))).first()
    assert (r["change_frequency"], r["author_count"], r["last_commit"]) == (2, 2, "bbbbbbbb")


def test_versioned_table(spark, tmp_path):
    t = K.VersionedTable(spark, f"file:{tmp_path}/t")
    assert t.read() is None
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    t.upsert(df([(1, "a"), (2, "b")]), ["k"])
    t.upsert(df([(2, "c"), (3, "d")]), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    t.delete(df([(1, "")]), ["k"])
    assert t.version() == 3 and t.read().count() == 2
    filled = K.backfill(df([(1, None), (2, "x")]), df([(1, "y"), (2, "z")]), ["k"], ["v"])
    assert sorted(map(tuple, filled.collect())) == [(1, "y"), (2, "x")]


def test_idempotent_append(spark, tmp_path):
    t = K.VersionedTable(spark, f"file:{tmp_path}/e")
    e = spark.createDataFrame([("k1", 1), ("k1", 1), (None, 2), (None, 2)], "idempotency_key string, n int")
    K.append_events(t, e)
    K.append_events(t, e)
    assert t.read().where("idempotency_key is not null").count() == 1 and t.read().where("idempotency_key is null").count() == 4


def test_vector_length(spark):
    d = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert K.vectors_of_size(d, 2).count() == 1
    with pytest.raises(Exception, match="vector length"):
        K.vectors_of_size(d, 3).collect()


def test_queue_with_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    good, bad = K.VersionedTable(spark, f"file:{tmp_path}/good"), K.VersionedTable(spark, f"file:{tmp_path}/bad")
    w = K.with_dead_letters(S.queue(spark, str(tmp_path / "in"), "id int"), "id", good, bad)
    w.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in good.read().collect()) == [1, 2] and bad.read().first()["raw"] == "not json"


def test_states():
    run = lambda step, rows: A.replay(iter(rows), step)[1]
    assert run(A.cooldown(3), [(0, ""), (2, ""), (3, ""), (5, "")]) == ["accepted", "ignored", "accepted", "ignored"]
    assert run(A.sliding_limit(2, 10), [(0, ""), (1, ""), (2, ""), (10.5, ""), (11.5, "")]) == ["allowed", "allowed", "rejected", "allowed", "allowed"]
    assert run(A.fixed_limit(1, 10), [(0, ""), (9, ""), (10, "")]) == ["allowed", "rejected", "allowed"]
    assert run(A.breaker(2, 5), [(0, "error"), (1, "error"), (2, "ok"), (7, "error"), (8, "ok"), (13, "ok"), (14, "error")]) == ["closed", "open", "open", "open", "open", "closed", "closed"]


def test_stateful_stream_equals_replay(spark, sf):
    from tessera.plans import streams

    got = {r["event_id"]: r["answer"] for r in streams.stream_rate_limit(spark, sf).collect()}
    e = sorted(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect())
    want, by = {}, {}
    for r in e:
        by.setdefault(r["user_id"], []).append(r)
    for rows in by.values():
        t = [((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds(), r["event_type"]) for r in rows]
        want.update(zip([r["event_id"] for r in rows], A.replay(iter(t), A.sliding_limit(2, 6 * 3600))[1]))
    assert got == want


PY = "import os\nfrom a.b import c\n\nclass A:\n    def f(self):\n        return g(1)\n\ndef h(x):\n    if x and x > 1:\n        for i in x:\n            pass\n"


def test_python_chunks():
    assert [(c[2], c[3]) for c in C.python_chunks(PY)] == [("class", "A"), ("function", "h"), ("function", "f")]
    assert list(C.python_chunks("def (")) == []
    s = C.structure(PY)
    assert s["imports"] == ["os", "a.b"] and s["functions"] == ["f", "h"] and s["classes"] == ["A"] and s["calls"] == ["g"]
    assert C.ast_complexity(PY) == 2 + 1 + 1 + 1 + 2 * 2 and C.ast_complexity("(") is None


def test_text_chunkers_keep_all_text():
    text = ". ".join(f"Sentence {i} has some words in it" for i in range(400)) + "."
    chunks = list(C.sentence_chunks(text))
    assert len(chunks) > 3 and all(len(c[4]) <= 4 * 600 for c in chunks) and all(f"Sentence {i} " in "".join(c[4] for c in chunks) for i in range(400))
    code = "\n".join(f"line {i} = {i}" for i in range(600))
    got = list(C.code_chunks(code))
    assert got[0][0] == 1 and got[-1][1] == 600 and {x for c in got for x in c[4].split("\n")} == set(code.split("\n"))
    assert C.dispatch("short", "py") == [(1, 1, "whole", "", "short")]
    assert C.common_prefix_lines("a\nb\nc", "a\nb\nx") == 2
    assert [c[3] for c in C.indent_chunks("function f() {\n  x\n}\nclass B {\n  y\n}")] == ["f", "B"]
    assert len(C.merge_small([(1, 1, "a", "", "x"), (2, 2, "a", "", "y"), (3, 3, "b", "", "z")])) == 2
