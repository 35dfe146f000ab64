"""Packing with tokenizers of other rules than the fast encoder follows."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

TEXTS = ["Hello  World, it's 42!", "", "ÉCOLE naïve\u3000x", "line\none\ttwo", "🙂 <|endoftext|> don't"]


def variants(tmp_path):
    base = packing.default_tokenizer()
    out = {"known": base, "bytes": base.replace("word_bpe_49k", "byte_bpe_50k")}
    with open(base, encoding="utf-8") as f:
        d = json.load(f)
    d["normalizer"] = None
    out["no normalizer"] = str(tmp_path / "plain.json")
    with open(out["no normalizer"], "w", encoding="utf-8") as f:
        json.dump(d, f)
    with open(base, encoding="utf-8") as f:
        d = json.load(f)
    d["model"]["vocab"] = {k: v + (70_000 if v > 40_000 else 0) for k, v in d["model"]["vocab"].items()}
    d["added_tokens"] = []
    out["large ids"] = str(tmp_path / "large.json")
    with open(out["large ids"], "w", encoding="utf-8") as f:
        json.dump(d, f)
    return out


def test_rules_are_checked(tmp_path):
    v = variants(tmp_path)
    assert {n: packing.has_known_rules(p) for n, p in v.items()} == {"known": True, "bytes": False, "no normalizer": False, "large ids": False}
    for path in v.values():
        ids, n = packing.Encoder.of_worker(path)(pa.array(TEXTS))
        want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, packing.END_ID] for t in TEXTS]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("name", ["bytes", "no normalizer"])
def test_packing_by_another_tokenizer(spark, tmp_path, name):
    path = variants(tmp_path)[name]
    rows = [(i, t * (1 + i % 3), "s") for i, t in enumerate(TEXTS * 6)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), tokenizer=path).collect()
    t = Tokenizer.from_file(path)
    for d, text, _ in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
