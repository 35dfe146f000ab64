"""The five stages of the pipeline, row by row, against plain Python."""

import collections
import hashlib
import math

import numpy as np
import xxhash

from tessera.llm import common, mixing, packing
from test_operators import DOCS, classes_brute, quality_brute, simhash_brute, words

LETTERS = str.maketrans("0123456789", "bcdfghjklm")


def key(t):
    k = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return k - (1 << 64) if k >> 63 else k


def quality(rows):
    def kept(t):
        n, chars, symbols, again, _, failed = quality_brute(t)
        lines = sum(bool(x.encode().split()) for x in (t or "").split("\n"))
        count = lambda f: sum(map(f, t or ""))
        full = [x for x in (y.strip(" \t\x0b\x0c\r") for y in (t or "").split("\n")) if x]
        w = words(t)
        most = lambda xs: max(collections.Counter(xs).values(), default=0)
        if 10 * sum(x[0] in "-*•" for x in full) > 9 * len(full) or 10 * sum(x.endswith(("...", "…")) for x in full) > 3 * len(full) or 10 * most(w) > 3 * n or 10 * most(zip(w, w[1:])) > 2 * n:
            return False
        return not (failed or 10 * symbols > 3 * n or 10 * again > 3 * lines or chars < 2 * n or chars > 20 * n or 10 * count("!?".__contains__) > 3 * n or 2 * count("0123456789".__contains__) > chars or 2 * count(lambda c: "A" <= c <= "Z") > chars)

    return [r for r in rows if kept(r[1])]


def one_of_each(rows):
    fp = [simhash_brute(r[1]) for r in rows]
    root, groups = classes_brute(fp), collections.defaultdict(list)
    for r, f in zip(rows, fp):
        groups[root[f]].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, key(r[1]))) for g in groups.values()]


def without_repeats(rows, n=400):
    seen = collections.Counter(b[i : i + n] for b in (r[1].encode() for r in rows) for i in range(len(b) - n + 1))
    out = []
    for i, t, lang, source, chars in rows:
        b = t.encode()
        mark = bytearray(len(b) + 1)
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                mark[j : j + n] = b"\1" * n
        # A character goes only if all its bytes are marked.
        left, at = [], 0
        for c in t:
            m = len(c.encode())
            if not all(mark[at : at + m]):
                left.append(c)
            at += m
        if not any(mark):
            out.append((i, t, lang, source, chars))
        elif left:
            out.append((i, "".join(left), lang, source, len(left)))
    return out


def mixed(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = [sum(len(words(r[1])) for r in by[s]) for s in order]
    target = mixing.water_fill([float(x) for x in size], [mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i in range(len(order))], mixing.TOTAL_SHARE * sum(size), mixing.CAP)
    out = []
    for s, n, t in zip(order, size, target):
        e = min(t / n, mixing.CAP)
        whole = math.floor(e + 1e-9)
        p, upto, drawn = max(e - whole, 0.0), 0, []
        for r in by[s]:
            said = "\x01".join([str(mixing.SEED), "null" if r[0] is None else str(r[0])]).encode()
            u = (int(hashlib.sha256(said).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            drawn.append((u / (1 - u), r[0] is not None, r[0] or 0, key(r[1]), r))
        for *_, r in sorted(drawn, key=lambda x: x[:4]):
            m, owed = len(words(r[1])), t - n * whole
            upto += m
            out += [r] * (whole + (p > 1e-12 and abs(upto - owed) <= abs(upto - m - owed)))
    return out


def tokens(rows):
    """How often each token of each text is to be served, by id, place and token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    return collections.Counter((r[0], at, t) for r, e in zip(rows, tok.encode_batch([r[1] for r in rows], add_special_tokens=False)) for at, t in enumerate(e.ids + [1]))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_rows_of_each_stage(spark, tmp_path):
    import corpus_pipeline as cp

    want = [(i, t and t.translate(LETTERS), "en", s, None if t is None else len(t)) for i, t, s in DOCS]
    sf = str(tmp_path / "sf")
    d = spark.createDataFrame(want, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    d.write.parquet(f"{sf}/documents.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [len(want)]
    for (name, stage), brute in zip(cp.STAGES[:4], (quality, one_of_each, without_repeats, mixed)):
        want, d = brute(want), common.work_table(stage(spark, d, sf), "t")
        assert ordered(d.select(*cp.COLUMNS).collect()) == ordered(want), name
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and len(want) != sizes[3]
    got = collections.Counter()
    for r in cp.run(spark, sf).collect():
        assert r["length"] == len(r["ids"])
        got.update((r["doc_id"], r["start"] + k, int(t)) for k, t in enumerate(np.array(r["ids"])))
    assert got == tokens(want)
