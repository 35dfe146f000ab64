"""Each operator against brute force on small, awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import same_as_sql
from tessera.llm import common, cotraining, katz, knn, licenses, mixing, packing, quality_rules, queries, simhash, suffix_dedup, textkernel, url_filter

random.seed(5)
WORDS = ["alpha", "béta", "Gamma", "x", "the", "of"] + [f"w{i}" for i in range(300)]
text = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
PASSAGES = [text(130) for _ in range(3)]


def awkward():
    """Ids, texts, sources: copies, near copies, shared passages, nulls, empty, long and repetitive texts."""
    out = []
    for i in range(40):
        t = text(random.randint(0, 150))
        for _ in range(random.randint(0, 2)):
            a = random.randint(0, 200)
            t += random.choice(PASSAGES)[a : a + random.randint(300, 700)] + text(random.randint(0, 60))
        out.append((i, t, f"s{i % 4}"))
    out += [(100, out[3][1], "s0"), (101, out[3][1] + " more", "s0"), (102, "ab" * 600, None), (103, "a" * 401, "s1"), (104, None, "s2"), (105, "", "s2"), (106, "line of text\n" * 80, "s3"), (None, out[5][1], "s1")]
    out += [(200 + i, PASSAGES[0][50:650] + text(20), "s9") for i in range(12)]
    out += [(13, out[13][1], out[13][2]), (7, "another text with the id seven", "s1"), (9, out[9][1], out[9][2]), (300, " ".join(WORDS) * 40, "s5")]
    return out


DOCS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    return d.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "key": F.lit("clash"), "fp": F.lit(1), "marks": F.lit(2), "size": F.lit("x"), "__k": F.lit(0)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_kernel_hash_and_blocks():
    import pyarrow as pa

    got = list(textkernel.blocks(pa.array(["aé b", None, "", "c" * 50]), limit=10))
    assert [b.n for b in got] == [3, 1] and got[0].text(0) == "aé b".encode() and got[1].first == 3
    h = textkernel.Hasher(np.frombuffer(b"abcabcd", np.uint8))
    assert h(np.array([0]), np.array([3])) == h(np.array([3]), np.array([6])) != h(np.array([1]), np.array([4]))
    assert textkernel.repeated(np.array([3, 1, 3, 2], np.uint64)).tolist() == [True, False, True, False]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (12, 11), (5, 5), (3, 1)], "a long, b long")
    assert sorted(map(tuple, common.components(e).collect())) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10)]
    assert common.components(e.limit(0)).count() == 0


def test_work_tables_can_be_cleared(spark):
    t = common.work_table(spark.range(3), "x")
    assert t.count() == 3
    common.clear_work_tables(spark)
    with pytest.raises(Exception):
        common.work_table(spark.range(3), "y").unionByName(t).collect()


def quality_brute(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_rules(docs, empty):
    got = quality_rules.quality_rules(docs, ["doc_id"]).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted((str(i), *quality_brute(t)) for i, t, _ in DOCS)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    kept = quality_rules.quality_rules(docs, ["doc_id", "text"], only_kept=True)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.quality_rules(empty, ["doc_id"]).count() == 0


def test_quality_rules_reject_junk(spark):
    good = " ".join(f"wort{i}" for i in range(60)).replace("1", "a").replace("2", "b")
    ten = [good[i * 30 : i * 30 + 30] for i in range(10)]
    rows = [(1, good), (2, " ".join(w + "!!" for w in good.split())), (3, good.upper()), (4, good.replace(" ", " # ")), (5, "\n".join(good[i * 30 : i * 30 + 30] + "\ngleich so" for i in range(14))), (6, "9876543210 " * 3 + " ".join(str(i) * 5 for i in range(40)))]
    rows += [(7, "\n".join("  - " + x for x in ten)), (8, "\n".join(x + " ..." for x in ten)), (9, " ".join(w if i % 2 else "same" for i, w in enumerate(good.split()))), (10, " ".join(w if i % 4 > 1 else ("one", "pair")[i % 4] for i, w in enumerate(good.split())))]
    rows += [(11, "\n".join(["  - " + x for x in ten[:9]] + ten[9:])), (12, "\n".join([x + " ..." for x in ten[:3]] + ten[3:])), (13, " ".join(w.replace("wort", "mot") + " ok" * (i % 3 == 0) for i, w in enumerate(good.split()))), (14, "word " * 200_000), (15, good + " " + " ".join(f"rare{i}" for i in range(100_000)).translate(str.maketrans("0123456789", "bcdfghjklm")))]
    d = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    got = {}
    for r in quality_rules.quality_rules(d, ["doc_id"]).collect():
        assert got.setdefault(r[0], r["kept"]) == r["kept"] and r["base_failed"] == (r[0] == 14)
    assert {i for i, k in got.items() if k} == {1, 11, 12, 13, 15}
    for rule in quality_rules.RULES:
        alone = {r[0] for r in quality_rules.quality_rules(d, ["doc_id"], rules=[rule]).where("not kept and not base_failed").collect()}
        assert alone == {"symbols per word": {4}, "repeated lines": {5}, "word length": set(), "shouting": {2}, "digits": {6}, "capitals": {3}, "lists": {7}, "cut lines": {8}, "one word": {4, 9}, "one pair of words": {10}}[rule.name], rule.name


def test_order_is_greedy_on_what_is_left():
    # rule 0 rejects most, rule 1 nothing that rule 0 leaves, rule 2 little but cheaply
    masks = {0: 50, 0b011: 30, 0b001: 10, 0b100: 5}
    assert quality_rules.greedy_order([1.0, 1.0, 1.0], masks) == [0, 2, 1]
    assert quality_rules.greedy_order([1.0, 1.0, 0.001], masks) == [2, 0, 1]
    assert quality_rules.greedy_order([0.0, 0.0], {}) == [0, 1]


def suffix_brute(rows, n=400):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = collections.Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = []
    for d, t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                m[i : i + n] = b"\1" * n
        out.append((d, len(t), sum(m), sum(1 for i in range(len(t)) if m[i] and not (i and m[i - 1])), hashlib.sha256(bytes(x for x, y in zip(t, m) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 4])
def test_suffix_dedup(docs, hot):
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs, hot=hot).collect()), key=str)
    assert got == suffix_brute(DOCS) and sum(r[2] for r in got) > 5000
    again = sorted((tuple(r) for r in suffix_dedup.digests(docs.repartition(7, "source"), hot=hot).collect()), key=str)
    assert again == got


def test_suffix_dedup_empty_and_texts(docs, empty):
    assert suffix_dedup.digests(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    out = suffix_dedup.remove_repeats(docs.select("doc_id", "text", "n_chars", "marks"))
    assert out.columns == ["doc_id", "text", "n_chars", "marks"]
    left = {r["doc_id"]: r for r in out.collect()}
    assert not {102, 103} & set(left) and 104 in left and left[104]["text"] is None and all(r["n_chars"] == len(r["text"]) for r in left.values() if r["text"] is not None)


def test_cuts_keep_whole_characters(spark):
    """Where a repeat begins or ends inside a character, the character stays."""
    shared = PASSAGES[0][:600]
    rows = [(1, "aaaé" + shared + "é bbb"), (2, "cccĩ" + shared + "è ddd"), (3, "none of it"), (4, shared[:300])]
    assert "é".encode()[1] == "ĩ".encode()[1] and "é".encode()[0] == "è".encode()[0]
    d = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(d).collect()))
    want = [(1, "aaaéé bbb"), (2, "cccĩè ddd"), (3, "none of it"), (4, shared[:300])]
    assert got == [(i, t, len(t)) for i, t in want]


def test_one_line_repeated_very_often(spark):
    """A gram that one document holds thousands of times, and an equal pair of long texts."""
    line = "the same line of text over and over again, to the end of the page and beyond\n"
    long = text(30_000)
    rows = [(1, line * 3000, ""), (2, line * 3 + "x", ""), (3, long, ""), (4, long[:-1], ""), (5, "", "")]
    got = sorted(tuple(r) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect())
    assert got == suffix_brute(rows)


def test_long_document_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    data = np.frombuffer((text(700)).encode(), np.uint8)
    b = textkernel.Block(data, np.array([0, len(data)]), 0)
    covered = set()
    for p, shift in suffix_dedup.pieces(b, 400):
        a = suffix_dedup.anchors(p)
        covered |= {x for lo, hi in zip(a["lo"] + shift, a["hi"] + shift) for x in range(lo, hi + 1)}
    assert covered == set(range(len(data) - 399))


def test_loser_tree_merges_front_coded_runs():
    items = [bytes(random.choices(b"ab", k=random.randint(0, 9))) for _ in range(300)]
    runs = []
    for k in range(7):
        part = sorted(items[k::7])
        lcp = suffix_dedup.neighbours(part)
        runs.append([(int(n), s[n:], None) for n, s in zip(lcp, part)])
    got = list(suffix_dedup.LoserTree(runs))
    assert [g[1] for g in got] == sorted(items)
    assert [g[0] for g in got] == suffix_dedup.neighbours(sorted(items)).tolist()


def simhash_brute(t):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_brute(fps):
    """Class of each distinct fingerprint by comparing all."""
    d, up = sorted(set(fps)), {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for i, a in enumerate(d):
        for b in d[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in d}


def test_very_long_texts(spark):
    """One text of over a megabyte among short ones, in the operators that read texts."""
    rng = random.Random(11)
    long = " ".join(rng.choice(WORDS) for _ in range(300_000))
    rows = [(1, long, "a"), (2, "short text " + text(40), "a"), (3, None, None), (4, long + " end", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    fp = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in fp.items()} == {i: simhash_brute(t) for i, t, _ in rows} and fp[4]["component_id"] == 1
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(d).collect()} == {1: len(long.encode()), 2: 0, 3: 0, 4: len(long.encode())}
    got = sorted((str(r[0]), *r[1:]) for r in katz.katz_scores(d, block_tokens=5000, part_keys=4000).collect())
    want = katz_brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want] and [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]])
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sources(d).collect()} == {i: len(words(t)) for i, t, _ in rows}
    e = packing.Encoder(packing.default_tokenizer())
    size = {i: len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    packed = packing.pack(d).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == size and sum(r["length"] for r in packed) == sum(size.values())


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fp = [simhash_brute(t) for _, t, _ in DOCS]
    root = classes_brute(fp)
    low = {}
    for (i, _, _), f in zip(DOCS, fp):
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    want = sorted((str(i), f, low.get(root[f])) for (i, _, _), f in zip(DOCS, fp))
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(low.values()))


def test_one_of_each_class(spark, docs, empty):
    """The stage keeps a row of each class: of those with null ids only, and of those that share an id."""
    import corpus_pipeline as cp

    rows = [(i, t, s) for i, t, s in DOCS] + [(None, "first text without an id " + text(80), "s1"), (None, "second text without an id " + text(80), "s2"), (-(1 << 63), "least id " + text(80), "s2")]
    rows += [(None, rows[-3][1], "s3"), (8, "another text with the id eight " + text(80), "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    fp = [simhash_brute(t) for _, t, _ in rows]
    root, first = classes_brute(fp), {}
    for (i, t, _), f in zip(rows, fp):
        first.setdefault(root[f], []).append((i is None, i or 0, t or ""))
    got = cp.near_duplicates(spark, d, "").collect()
    kept = collections.Counter(root[simhash_brute(r["text"])] for r in got)
    assert kept == collections.Counter(first.keys()) and len(got) == len(first)
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == min(first[root[simhash_brute(r["text"])]])[:2] for r in got)
    ids = collections.Counter(r["doc_id"] for r in got)
    assert ids[None] == 2 and ids[7] == ids[8] == 2 and ids[-(1 << 63)] == 1
    assert simhash.one_of_each_class(empty).count() == 0


@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_blocks_lose_no_link(n):
    masks = [m for _, m in simhash.block_choices(n)]
    for _ in range(300):
        d = sum(1 << b for b in random.sample(range(64), 4))
        assert any(not d & m for m in masks)


def test_bk_tree_of_a_dense_group():
    centre = random.getrandbits(64)
    fps = sorted({centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(300)} | {random.getrandbits(64) for _ in range(300)})
    tree = simhash.BKTree(4)
    edges = sum(len(tree.add(x)) for x in fps)
    want = classes_brute(fps)
    assert {tree.fp[i]: tree.fp[tree.find(i)] for i in range(len(fps))} == want and edges < len(fps)


URLS = ["https://www.Example.com/en/1", "http://a.example.com/en/2?x", "http://example.com/fr/3", "x://example.net/es/4#t", "http://net/fr/", "http://example.net/fr", "no url", None, "", "http://", "http://a.com:80/en/", "https://example.com?q=/en/", "http://xexample.com/en/"]


def url_brute(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(h), len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


@pytest.mark.parametrize("limit", [url_filter.MAX_BROADCAST_RULES, 0])
def test_url_filter(spark, limit):
    d = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = sorted(tuple(r) for r in url_filter.url_filter(d, url_filter.RULES, max_broadcast=limit).collect())
    assert got == [(i, *url_brute(u)) for i, u in enumerate(URLS * 2)]
    assert url_filter.url_filter(d.limit(0), url_filter.RULES, max_broadcast=limit).count() == 0


def test_open_path_rules():
    t = url_filter.Trie([("block", "a.com", "/pre"), ("allow", "a.com", "/prefix/x"), ("block", "com", "/")])
    assert [t.find("a.com", p) for p in ("/prefix/y", "/prefix/xyz", "/q", "")] == [("a.com/pre", "block"), ("a.com/prefix/x", "allow"), ("com/", "block"), None]


def katz_brute(rows):
    toks = lambda t: [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(t)] + ["<end>"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c1, c2, ch = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        if not held(i):
            w = toks(t)
            p = ["<s>", *w[:-1]]
            c1.update(w), c2.update(zip(p, w)), ch.update(p)
    n, v = sum(c1.values()), len(c1)
    d1, d2 = (katz.discounts(collections.Counter(c.values())) for c in (c1, c2))
    disc = lambda c, d: c * d[c] if c < len(d) else c
    kept = sum(disc(c, d1) for c in c1.values())
    total = n + 1 if n - kept < 1e-9 * max(n, 1) else n
    unknown = 1 - kept / total if n else 1.0
    word = lambda w: disc(c1[w], d1) / total if c1[w] else unknown
    by = collections.defaultdict(list)
    for (h, w), c in c2.items():
        by[h].append((w, c))
    ctx = {}
    for h, pairs in by.items():
        m = sum(disc(c, d2) for _, c in pairs)
        den = ch[h] + 1 if ch[h] - m < 1e-9 * ch[h] else ch[h]
        ctx[h] = (den, (1 - m / den) / (1 - sum(word(w) for w, _ in pairs)))
        assert sum(disc(c2[h, w], d2) / den if c2[h, w] else ctx[h][1] * word(w) for w in c1) + ctx[h][1] * unknown == pytest.approx(1)
    out = []
    for i, t, _ in rows:
        w = toks(t)
        s = sum(math.log10(disc(c2[h, x], d2) / ctx[h][0] if c2[h, x] else ctx.get(h, (0, 1))[1] * word(x)) for h, x in zip(["<s>", *w[:-1]], w))
        out.append((str(i), held(i), len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), s))
    return sorted(out)


def test_katz(docs, empty):
    got = sorted((str(r[0]), *r[1:]) for r in katz.katz_scores(docs, block_tokens=2000, part_keys=1500).collect())
    want = katz_brute(DOCS)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]])
    assert katz.katz_scores(empty).count() == 0


def test_katz_without_training(spark):
    i = next(i for i in range(100) if katz.held_out(i))
    r = katz.katz_scores(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0)


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(DOCS)
    size = collections.Counter()
    for _, t, s in DOCS:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2.0)))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    biggest = {s: max(len(words(t)) for _, t, x in DOCS if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["key"], r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["key"], r["taken"]) for r in again)
    assert mixing.mix_sources(empty).count() == 0


def test_water_fill():
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 315, 2.0) == pytest.approx([20, 590 / 3, 295 / 3])
    assert sum(mixing.water_fill([5, 5], [1, 1], 100, 2.0)) == 20


def test_mixing_follows_inclusion(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 0.5).otherwise(1.0).alias("w"))
    got = mixing.mix_sources(d, weights=(1.0,), total_share=0.3, propensity="w").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    n = {r["odd"]: r["n"] for r in got}
    assert abs(sum(n.values()) - got[0]["t"]) <= 2 and n[1] / n[0] == pytest.approx(2, abs=0.15)


def labelled_corpus():
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        bad = i % 4 == 0
        t = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            t[rng.randrange(60)] = rng.choice(["vileword", "badprefixone", "badprefixtwo"])
        rows.append((i, " ".join(t), ("junk" if bad and i % 8 else "src") + str(rng.randrange(3)), "en"))
        if i < 500:
            labels.append((i, 1, int(bad)))
    rows += [rows[3], (3, rows[700][1], "src1", "de"), (None, None, None, None), (None, "vileword " * 30, None, "en"), (901, None, None, "en"), (902, "", "src0", None), (903, "of the word " * 40_000, "src1", "en")]
    return rows, labels + [(None, 1, 1), (3, None, 0), (7, 0, 0)]


def test_cotraining(spark, docs, empty):
    rows, labels = labelled_corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"y": F.lit(1), "h": F.lit("clash"), "key": F.lit(0), "__i": F.lit(1)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotraining.classify(d, lab).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(rows) and sum(kept[i] != (i % 4 != 0) for i in range(500, 900)) <= 6
    # neither the layout of the table nor another run changes a bit
    score = lambda rs: sorted((str(r["doc_id"]), r["text_logit"], r["meta_logit"], r["score"], r["kept"]) for r in rs)
    for other in (d.repartition(5, "source"), d.orderBy(F.desc("text")).coalesce(2)):
        assert score(cotraining.classify(other, lab.repartition(3)).collect()) == score(got)
    assert cotraining.classify(empty, lab).count() == 0
    assert {r["kept"] for r in cotraining.classify(docs, lab.limit(0)).collect()} == {True} and cotraining.classify(docs, lab.limit(0)).count() == len(DOCS)


def test_cotraining_exchange_against_brute_force(spark):
    """Labelled rows, the rows exchanged in each round and the scores, from plain lists that hold every document."""
    import pyarrow as pa

    rows, labels = labelled_corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    how = {"rounds": 2, "per": 25, "confident": 0.8}
    keyed = d.withColumn("h", cotraining.order_key()).withColumn("y", F.lit(-1))
    feats = {(r["h"], r["meta"]): r.asDict() for r in cotraining.features(keyed).collect()}
    everything = []
    for r in keyed.collect():
        size = math.floor(math.log2(max(len((r["text"] or "").encode()), 1)))
        meta = np.array([zlib.crc32(f"{k}\x00{v!r}".encode()) % cotraining.BUCKETS for k, v in (("source", r["source"]), ("lang", r["lang"]), ("size", size))], "<u4").tobytes()
        everything.append((r["doc_id"], r["h"], r["text"] or "", r["source"], r["lang"], feats[r["h"], meta]))
    good = {}
    for i, q, x in labels:
        if None not in (i, q, x):
            good.setdefault(i, []).append((q, x))
    good = {i: int(min(q for q, _ in v) > 0 and max(x for _, x in v) <= 0) for i, v in good.items()}
    assert good[7] == 0 and good[3] == 1

    def exchange(step, model):
        out = []
        part = [e for e in everything if e[0] not in good and e[1] % 2 == step]
        both = [[float(x[0]) for x in cotraining.logits(next(textkernel.blocks(pa.array([e[2]]))), [e[3]], [e[4]], model.weights)] for e in part]
        for view in (0, 1):
            picked = []
            for want in (0, 1):
                p = [(float(cotraining.sigmoid(x[view])) if want else 1 - float(cotraining.sigmoid(x[view])), e) for x, e in zip(both, part)]
                p = sorted((q for q in p if q[0] >= 0.8), key=lambda q: (-q[0], q[1][1]))[:25]
                picked += [e[5] | {"y": want} for _, e in p]
            out.append(cotraining.Rows(picked))
        sizes.append([r.n for r in out])
        return out

    sizes = []
    want = cotraining.co_train(cotraining.Rows([e[5] | {"y": good[e[0]]} for e in everything if e[0] in good]), exchange, 2)
    got = cotraining.fitted(d, lab, **how)
    assert sum(map(sum, sizes)) > 60
    assert np.array_equal(got.text.weight, want.text.weight) and np.array_equal(got.meta.weight, want.meta.weight) and got.mixed == want.mixed and got.text.bias == want.text.bias


def knn_brute(rows, k=5):
    ok = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % 50 == 0:
            c = sorted((-sum(a * b for a, b in zip(q, v)), j if j is not None else 2**63, m) for m, j, v in ok if m != n and len(v) == len(q))
            out += [(i, r + 1, None if j == 2**63 else j, -s) for r, (s, j, _) in enumerate(c[:k])]
    return sorted(out, key=str)


def test_knn(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype("f4")]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2050, [float("inf")] * 8), (None, rows[0][1]), (50, rows[3][1]), (2100, [1.0, 2.0]), (2101, [0.5, 0.5]), (2150, [1.0] * 3)]
    rows += [(2200, []), (2250, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"uid": F.lit("x"), "v": F.lit(1), "q": F.lit(2), "grp": F.lit(3)})
    for pivots in (None, 60):
        got = knn.knn_join(d, F.col("vec_id") % 50 == 0, pivots=pivots)
        assert sorted((tuple(r) for r in got.collect()), key=str) == knn_brute(rows), pivots
    assert knn.knn_join(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_knn_prunes_and_splits(spark, monkeypatch):
    """Clustered vectors: block pairs are left out, a vector of many copies is dealt over blocks, and the result is whole."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 6)) * 20
    rows = [(i, [float(x) for x in (centre[i % 12] + rng.normal(size=6) * 0.3).astype("f4")]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    monkeypatch.setattr(knn, "DATA_BLOCK", 40)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    assert sorted((tuple(r) for r in knn.knn_join(d, F.col("vec_id") % 50 == 0).collect()), key=str) == knn_brute(rows)
    there, pivots, width = knn.placed(knn.usable(d.withColumn("q", F.col("vec_id") % 50 == 0), "q"), 6, 24)
    blocks, groups = knn.cut_in_blocks(there, width, 5)
    n = {r[0]: r[1] for r in blocks.groupBy("query").count().collect()}
    left = knn.needed(blocks, knn.Bounds(pivots, groups.toPandas(), 5)).count()
    assert blocks.where("not query").agg(F.max("n")).first()[0] <= 80 and 0 < left < 0.8 * n[True] * n[False], (left, n)


def test_knn_large_values():
    q, x = np.array([[3.0e9, 1.0]]), np.array([[2.0e9, 5.0]])
    assert knn.products(q, x)[0, 0] == 3 * 10**9 * 2 * 10**9 + 5


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = collections.Counter()
    byid = {}
    for (i, t, _), e in zip(DOCS, tok.encode_batch([t or "" for _, t, _ in DOCS], add_special_tokens=False)):
        ids[i, tuple(e.ids + [1])] += 1
        byid.setdefault(i, []).append(np.array(e.ids + [1], "<u4"))
    got = packing.pack(docs, size=64, with_ids=True).collect()
    assert sum(r["length"] for r in got) == sum(len(k[1]) * n for k, n in ids.items())
    for r in got:
        raw = np.array(r["ids"], "<i4").tobytes()
        assert zlib.crc32(raw) == r["ids_crc32"] and any(len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]].tobytes() == raw for x in byid[r["doc_id"]])
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    fill = {s: sum(n for _, n in p) for s, p in seqs.items()}
    for p in seqs.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values()) and sum(n != 64 for n in fill.values()) <= 6
    assert packing.pack(empty).count() == 0


def pieces_by_source(rows, got):
    """Tokens of each source in each sequence, in order of sequences, and how often each document is cut."""
    source = {i: s for i, _, s in rows}
    by, cuts = collections.defaultdict(collections.Counter), collections.Counter()
    for r in got:
        by[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
        cuts[r["doc_id"]] += 1
    return by, cuts


@pytest.mark.parametrize("chunk,targets", [(1 << 19, None), (4096, None), (4096, {"a": 0.7, None: 0.2})])
def test_windows_hold_target_shares(spark, chunk, targets):
    """What a source has got by the end of any window of any chunk stays near what it is due; deficits pass from chunk to chunk."""
    rng, size = random.Random(3), 256
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 20, 40, 90, 400]))), rng.choice(["a", "a", "b", "c", None])) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("chunk", F.lit("clash"))
    got = packing.pack(d, size=size, targets=targets, chunk=chunk).collect()
    by, cuts = pieces_by_source(rows, got)
    total = collections.Counter()
    for c in by.values():
        total.update(c)
    n = sum(total.values())
    share = {s: (targets or {}).get(s, total[s] / n) for s in total}
    served, longest = collections.Counter(), max(r["doc_tokens"] for r in got)
    bound = 2 * size if chunk > n else 2 * size + longest  # the last document of a chunk is served there to its end
    for seq in sorted(by):
        served.update(by[seq])
        # the ideal mix that has served as many tokens in all
        low, high = 0.0, float(n) / min(share.values())
        for _ in range(60):
            t = (low + high) / 2
            low, high = (t, high) if sum(min(total[s], share[s] * t) for s in total) < sum(served.values()) else (low, t)
        assert all(abs(served[s] - min(total[s], share[s] * t)) <= bound for s in total)
    short = {r["doc_id"] for r in got if r["doc_tokens"] <= size}
    assert served == total and sum(cuts[i] == 1 for i in short) >= 0.8 * len(short)


def test_round_robin_carries_deficits():
    share = np.array([0.5, 0.5])
    got = packing.round_robin([10, 10, 10, 10], [0, 0, 1, 1], share, np.array([0.0, 20.0]), size=10)
    assert [p[0] for p in got] == [2, 3, 0, 1] and all(p[1:3] == [0, 10] for p in got)
    got = packing.round_robin([7, 7, 2], [0, 0, 1], share, np.zeros(2), size=8)
    assert got == [[2, 0, 2, 0, 0], [0, 0, 6, 0, 2], [0, 6, 1, 1, 0], [1, 0, 7, 1, 1]]
    # the end of a chunk: 13 tokens as 8, 4 and 1
    assert packing.round_robin([13], [0], np.ones(1), np.zeros(1), size=64) == [[0, 0, 8, 0, 0], [0, 8, 4, 1, 0], [0, 12, 1, 2, 0]]
    assert packing.round_robin([], [], np.zeros(0), np.zeros(0)) == []


def test_packing_targets_are_checked(docs):
    for bad in ({"s0": 0}, {"s0": 1.5}, {f"s{i}": 0.1 for i in range(1001)}):
        with pytest.raises(ValueError):
            packing.pack(docs, targets=bad)


def test_encoder_equals_tokenizer():
    import pyarrow as pa

    e = packing.Encoder(packing.default_tokenizer(), cache=500)
    hard = ["İstanbul ΣΑΣ don't I'LL x's   a b café CAFÉ a)b). \"q\" it's!! 's", "", " ", "A\tB\x0bc\u00a0d\u2028e", "12 3a4 ²½", "'re''ve", "<|endoftext|> x", "e\u0301 \u0301 가\u1100\u1161", "日本語 ok?!"] + [t or "" for _, t, _ in DOCS]
    hard += ["x <|EndOfText|>y", "a--b_c (d) e/f1g2h3, 4.5% ×÷ ÀÞß ÿ Ÿ ªº µ", "ĲÅÃ\u00c3\u0301 \u00c3A", "é", "\u00c3", "a" * 3000 + " " + "ü" * 3000, "no.1's 2nd-3rd"]
    want = [x.ids + [1] for x in e.tokenizer.encode_batch(hard, add_special_tokens=False)]
    for texts in (hard, hard, hard[5:9], hard[::-1][:40][::-1]):
        ids, n = e(pa.array(texts))
        at = hard.index(texts[0]) if len(texts) == 4 else len(hard) - len(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[at : at + len(texts)]


def test_encoder_on_every_character():
    """Each character of the first plane, alone, after a letter and before one."""
    import pyarrow as pa

    e = packing.Encoder(packing.default_tokenizer())
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c} a{c} {c}b A{c}1" for c in chars]
    ids, n = e(pa.array(texts))
    want = [x.ids + [1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [hex(ord(c)) for c, x, y in zip(chars, np.split(ids, np.cumsum(n)[:-1]), want) if x.tolist() != y]
    assert not bad


MIT = "MIT License\n\nCopyright (c) someone\n\n" + next(s for i, s in licenses.SENTENCES if i == "mit-grant") + ":\n\n" + next(s for i, s in licenses.SENTENCES if i == "mit-keep") + "."


def test_licenses(spark, empty):
    rows = [(1, MIT), (2, MIT.replace("software", "software\n").upper()), (3, "Text. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nMore"), (4, "this mentions a license only"), (5, None), (6, ""),
            (7, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), (8, "Released under the MIT License. Released under the MIT License."), (8, "x " * 100000 + "\nLicensed under CC BY-NC 4.0.\n")]
    got = sorted((r[0], r[1] or "", r[2], r[3]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 3, 0), (2, "MIT", 3, 0), (3, "Apache-2.0,MIT", 2, 0), (4, "", 0, 0), (5, "", 0, 0), (6, "", 0, 0), (7, "", 1, 1), (8, "CC-BY-NC-4.0", 1, 0), (8, "MIT", 2, 0)]
    assert licenses.scan(empty).count() == 0


GPL = """Copyright (C) 2020  someone

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful, but without any warranty.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""


def test_licenses_with_marks_inside(spark):
    """Each listed sentence is found in a text that holds it, and so are the usual headers of two licences."""
    r = licenses.Recogniser()
    for i, s in licenses.SENTENCES:
        for t in (s, f"Some text. {s}.\nMore text.", f"Some text\n{s}\nMore text", f"Some text.\n\n{s}; {s}."):
            assert r.identifiers(t) == [i] * t.count(s), (i, t)
    assert {n for n, seq in licenses.RULES if r.licences(list(seq)) != ([n], 0)} == set()
    rows = [(1, GPL), (2, MPL), (3, GPL.replace("    ", "# ") + MPL), (4, "This program is free software: you may not copy it."), (5, "Mozilla Public License, v. 2.0")]
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "GPL-3.0-or-later", 1, 0), (2, "MPL-2.0", 1, 0), (3, "GPL-3.0-or-later,MPL-2.0", 2, 0), (4, None, 0, 0), (5, None, 0, 0)]


def licence_texts():
    """Documents that hold every rule, some broken, and other prose."""
    first = {}
    for i, x in licenses.SENTENCES:
        first.setdefault(i, x)
    rng, out = random.Random(8), []
    for _, seq in licenses.RULES:
        parts = [first[i] for i in seq]
        out += [". ".join(parts) + ".", "\n".join(f"{i + 1}. {p.upper()}" for i, p in enumerate(parts)), "Intro text.\n\n" + ";\n\n".join(p.replace(" ", "\n * ", 2) for p in parts) + "\n\nThe end", ". other words. ".join(parts), ". ".join(parts[1:] + parts[:1])]
    out += [". ".join(rng.choice(licenses.SENTENCES)[1] for _ in range(8)) for _ in range(60)]
    return out + ["", None, "the license of nothing", "x " * 50_000 + "\nMIT License\n" + "y " * 50_000, out[0]]


def test_licenses_same_as_sql(spark):
    import duckdb

    rows = list(enumerate(licence_texts()))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licenses": F.lit("clash"), "n_sentences": F.lit("clash")})
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toPandas())
    same_as_sql(licenses.scan(d), con, licenses.SQL)
    found = {n for r in licenses.scan(d).collect() if r["licenses"] for n in r["licenses"].split(",")}
    assert found == {n for n, _ in licenses.RULES}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    same_as_sql(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline as cp

    (tmp_path / "sf").mkdir()
    docs = docs.drop("__k").withColumn("text", F.translate("text", "0123456789", "bcdfghjklm"))
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    for i, (name, stage) in enumerate(cp.STAGES):
        d = stage(spark, d, str(tmp_path / "sf"))
        if i < len(cp.STAGES) - 1:
            assert d.columns == cp.COLUMNS, name
            d = common.work_table(d, "t")
        if i == 0:
            assert {r["doc_id"] for r in d.collect()} == {r["doc_id"] for r in quality_rules.quality_rules(docs, ["doc_id"]).where("kept").collect()}
    assert d.count() == cp.run(spark, str(tmp_path / "sf")).count() > 0
    e = empty.select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        e = stage(spark, e, "")
    assert e.count() == 0
