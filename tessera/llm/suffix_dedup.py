"""Operator 2: remove repeated byte strings with a distributed suffix merge sort.

Sorting every suffix of the corpus would move many times its size, so the suffix array is sparse: in each window of
``length`` bytes the position of the smallest hash of ``GRAM`` bytes is an anchor.  Equal windows have their anchor at the same
place, so every repeat passes through two equal anchors.  An anchor serves a run of windows; their bytes together are its context.

1. Anchors are counted by gram.  A gram that occurs once has no repeat.  A context that occurs twice or more as a whole is repeated as a whole.
2. What is left are contexts that share a gram and differ (where a repeat begins or ends).  One of each is fetched; its right side is
   a suffix.  Tasks sort suffixes into runs, front-code them (length of the prefix shared with the one before, then the rest), and exchange the runs by gram.
3. A loser tree merges the runs of a bucket.  Each entry knows its common prefix with the last winner, so known prefixes are never compared again;
   the merge gives the suffix order with its common-prefix lengths.
4. For each offset of a window to its anchor, entries of one segment of the order (common prefix long enough) and with equal bytes to the left are repeats.

Work in steps 3 and 4 is in proportion to the entries, never to pairs.  A gram with more than ``HOT`` different contexts takes another exact way: its
windows are hashed and counted with partial sums, so that no task holds them together; the result is the same.

Defined cases: a null text is empty; a very long text is read in overlapping pieces of ``PIECE`` bytes, every window in one of them; no order among ties matters; other columns, whatever their names, are carried or ignored; a text below ``length`` bytes loses nothing; rows with one id and different texts are different documents, and equal rows are
copies of each other, so they are removed where they are long enough; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, row_key, same, small_batches, work_table
from tessera.llm.textkernel import Block, Hasher, U, blocks, mix, repeated

LENGTH, GRAM = 400, 64
PIECE = 1 << 20
RUN_ENTRIES = 20_000
BUCKET_ENTRIES = 20_000
HOT = 50_000
POS_BITS = 24


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    grid = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(b: Block, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """Anchors of a block: doc, pos, lo, hi (window starts it serves; all from the document's start), kg and ctx hashes."""
    span = length - gram + 1
    size = np.diff(b.off)
    if not (size >= length).any():
        return None
    h = Hasher(b.data)
    n = len(b.data) - gram + 1
    g = (h.sums[gram:] - h.sums[:n]) * h.q[:n]
    g = (g ^ (g >> U(32))) * U(0x9E3779B97F4A7C15)
    g = (g >> U(POS_BITS) << U(POS_BITS)) | np.arange(n, dtype=U)
    at = (sliding_min(g, span) & U((1 << POS_BITS) - 1)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int64)
    long = np.flatnonzero(size >= length)
    valid[b.off[long]] += 1
    valid[b.off[long + 1] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    a = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, pos = p[first], p[np.append(first[1:], len(p)) - 1], a[first]
    doc = np.searchsorted(b.off, lo, "right") - 1
    kg = h(pos, pos + gram)
    ctx = mix(h(lo, hi + length) + (pos - lo).astype(U) * U(0xD6E8FEB86659FD93))
    base = b.off[doc]
    return {"doc": doc, "pos": pos - base, "lo": lo - base, "hi": hi - base, "kg": kg.view(np.int64), "ctx": ctx.view(np.int64)}


def pieces(b: Block, length: int):
    """A long document in overlapping pieces, so that positions fit; each window lies in one piece."""
    if len(b.data) <= PIECE:
        yield b, 0
        return
    for i in range(0, len(b.data) - length + 1, PIECE - length + 1):
        d = b.data[i : i + PIECE]
        yield Block(d, np.array([0, len(d)]), b.first), i


def anchor_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    names = ["doc_id", "key", "pos", "lo", "hi", "kg", "ctx"]

    def run(batches):
        for batch in batches:
            for whole in blocks(batch.column(2)):
                for b, shift in pieces(whole, length):
                    got = anchors(b, length)
                    if got is not None:
                        rows = pa.array(got["doc"] + whole.first)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)] + [pa.array(got[c] + shift) for c in ("pos", "lo", "hi")] + [pa.array(got[c]) for c in ("kg", "ctx")], names)

    return docs.select("doc_id", row_key().alias("key"), F.col("text").alias("__text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return known + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class LoserTree:
    """Merges front-coded sorted runs of (common prefix with the one before, rest of the bytes, tag).

    ``head[i]`` is the common prefix of run i's first entry with the last winner; the longer one is the smaller string, and only
    equal heads are compared, from that length on.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = 1 << max(0, (len(self.runs) - 1).bit_length())
        self.text: list = [None] * self.k
        self.tag: list = [None] * self.k
        self.head = [0] * self.k
        self.lost = [0] * self.k
        for i in range(len(self.runs)):
            self._next(i, b"")
        self.top = self._build(1)

    def _next(self, i: int, before: bytes) -> None:
        got = next(self.runs[i], None)
        if got is None:
            self.text[i] = None
            return
        lcp, rest, self.tag[i] = got
        self.text[i], self.head[i] = before[:lcp] + rest, lcp

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's head becomes its common prefix with the winner."""
        x, y, head = self.text[a], self.text[b], self.head
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if head[a] != head[b]:
            return (a, b) if head[a] > head[b] else (b, a)
        n = common(x, y, head[a])
        if x[n:] <= y[n:]:
            head[b] = n
            return a, b
        head[a] = n
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        win, self.lost[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self):
        """(common prefix with the entry before, bytes, tag) in order."""
        while (text := self.text[self.top]) is not None:
            i = self.top
            yield self.head[i], text, self.tag[i]
            self._next(i, text)
            node = (i + self.k) // 2
            while node:
                i, self.lost[node] = self._play(i, self.lost[node])
                node //= 2
            self.top = i


def neighbours(texts: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before; 0 for the first."""
    out = np.zeros(len(texts), np.int64)
    for i in range(1, len(texts)):
        out[i] = common(texts[i - 1], texts[i], 0)
    return out


RUN = "bucket int, n int, lcp binary, size binary, rest binary, lsize binary, lefts binary, tags binary"
TAG = np.dtype([("doc", "<i8"), ("null", "<i8"), ("key", "<i8"), ("pos", "<i8"), ("n", "<i8")])


def sorted_runs(entries: list[tuple], buckets: int) -> list[tuple]:
    """Entries (kg, right, left, doc_id, key, pos, n) as front-coded runs, one for each bucket."""
    entries.sort(key=lambda e: (e[0] % buckets, e[1]))
    out, i = [], 0
    while i < len(entries):
        j, bucket = i, entries[i][0] % buckets
        while j < len(entries) and entries[j][0] % buckets == bucket:
            j += 1
        part = entries[i:j]
        lcp = neighbours([e[1] for e in part])
        rest = [e[1][n:] for e, n in zip(part, lcp)]
        tags = np.array([(e[3] or 0, e[3] is None, *e[4:]) for e in part], TAG)
        size = lambda xs: np.array([len(x) for x in xs], "<u2").tobytes()
        lefts = [e[2] for e in part]
        out.append((bucket, j - i, lcp.astype("<u2").tobytes(), size(rest), b"".join(rest), size(lefts), b"".join(lefts), tags.tobytes()))
        i = j
    return out


def read_run(n: int, lcp: bytes, size: bytes, rest: bytes, lsize: bytes, lefts: bytes, tags: bytes):
    at, lat = 0, 0
    tag = np.frombuffer(tags, TAG)
    for a, s, ls, t in zip(np.frombuffer(lcp, "<u2").tolist(), np.frombuffer(size, "<u2").tolist(), np.frombuffer(lsize, "<u2").tolist(), tag):
        yield a, rest[at : at + s], (lefts[lat : lat + ls], t)
        at, lat = at + s, lat + ls


def repeats(lcp: np.ndarray, right: np.ndarray, lefts: list[bytes], length: int) -> np.ndarray:
    """Entries in suffix order: which offsets of a window to the anchor are repeated (rows x offsets)."""
    m = len(lefts)
    low, high = length - right, np.array([len(x) for x in lefts])
    span = int(high.max()) + 1
    back = np.zeros((m, span), np.uint8)
    for i, x in enumerate(lefts):
        if x:
            back[i, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    out = np.zeros((m, span), bool)
    h = np.zeros(m, U)
    for o in range(span):
        if o:
            h = (h + back[:, o - 1].astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        on = np.flatnonzero((low <= o) & (o <= high))
        if len(on) > 1:
            seg = np.cumsum(lcp < length - o).astype(U)
            out[on, o] = repeated(mix(h[on] ^ mix(seg[on])))
    return out


def spans_of(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of repeated offsets as byte ranges from the anchor."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [(1 - int(b), length - int(a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def merge_bucket(pdf: pd.DataFrame, length: int) -> list[tuple]:
    runs = [read_run(*r) for r in pdf[["n", "lcp", "size", "rest", "lsize", "lefts", "tags"]].itertuples(index=False)]
    got = list(LoserTree(runs))
    lcp = np.array([g[0] for g in got])
    near = np.zeros(len(got), bool)
    near[1:] |= lcp[1:] >= GRAM
    near[:-1] |= lcp[1:] >= GRAM
    if not near.any():
        return []
    lcp = np.where(near, lcp, 0)[near]
    got = [g for g, x in zip(got, near) if x]
    mask = repeats(lcp, np.array([len(g[1]) for g in got]), [g[2][0] for g in got], length)
    out = []
    for row, (_, _, (_, t)) in zip(mask, got):
        if t["n"] == 1 and row.any():
            doc, pos = None if t["null"] else int(t["doc"]), int(t["pos"])
            out += [(doc, int(t["key"]), pos + a, pos + b) for a, b in spans_of(row, length)]
    return out


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents that hold wanted contexts, with the list of those."""
    per = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("kg", "pos", "lo", "hi", "n")).alias("want"))
    d = docs.select("doc_id", row_key().alias("key"), "text")
    return d.join(per, same(d, per, "doc_id", "key")).select(d["doc_id"], d["key"], "want", "text")


def boundary_marks(docs: DataFrame, wanted: DataFrame, entries: int, length: int) -> DataFrame:
    """Steps 2 to 4: (doc_id, key, start, end) of repeats inside contexts that occur once."""
    buckets = max(8, -(-entries // BUCKET_ENTRIES))

    def runs(batches):
        held: list[tuple] = []
        names = [x.split()[0] for x in RUN.split(", ")]

        def flush():
            cols = list(zip(*sorted_runs(held, buckets)))
            held.clear()
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for doc, key, want, text in zip(*(batch.column(i) for i in range(4))):
                raw, doc, key = text.as_py().encode(), doc.as_py(), key.as_py()
                for w in want.as_py():
                    pos, lo, hi = w["pos"], w["lo"], w["hi"]
                    held.append((w["kg"], raw[pos : hi + length], raw[lo:pos], doc, key, pos, w["n"]))
                if len(held) >= RUN_ENTRIES:
                    yield flush()
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = merge_bucket(pdf, length)
        out = pd.DataFrame(got, columns=["doc_id", "key", "start", "end"])
        return out.astype({"doc_id": "Int64", "key": "int64", "start": "int64", "end": "int64"})

    coded = contexts(docs, wanted).mapInArrow(runs, RUN)
    return coded.groupBy("bucket").applyInPandas(merge, "doc_id long, key long, start long, end long")


def hot_marks(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The same marks for grams with very many contexts: hashes of all their windows, counted with partial sums."""

    def windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(3)[i].as_py().encode(), np.uint8)
                want = batch.column(2)[i].as_py()
                for w in want:
                    part = raw[w["lo"] : w["hi"] + length]
                    h, p = Hasher(part), np.arange(w["hi"] - w["lo"] + 1)
                    one = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * one, pa.int64()), pa.array([batch.column(1)[i].as_py()] * one, pa.int64()), pa.array(p + w["lo"]), pa.array([w["kg"]] * one, pa.int64()), pa.array(h(p, p + length).view(np.int64)), pa.array([w["n"]] * one, pa.int64())], ["doc_id", "key", "start", "kg", "h", "n"])

    rows = work_table(contexts(docs, wanted).mapInArrow(windows, "doc_id long, key long, start long, kg long, h long, n long"), "hot-windows")
    twice = rows.groupBy("kg", "h").agg(F.count("*").alias("c")).where("c > 1").select("kg", "h")
    return rows.where("n = 1").join(twice, ["kg", "h"], "left_semi").select("doc_id", "key", "start", (F.col("start") + length).alias("end"))


def repeat_marks(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, key, marks) of each document with repeats: byte ranges that strings of ``length`` bytes found elsewhere cover."""
    a = work_table(anchor_table(docs, length), "anchors")
    twice = a.groupBy("kg").agg(F.count("*").alias("c"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("c > 1")
    twice = work_table(twice.select("kg", (F.col("a") != F.col("b")).alias("mixed")), "shared-grams")
    shared = work_table(a.join(twice, "kg"), "shared-anchors")
    whole = F.struct("doc_id", "key", "pos", "lo", "hi")
    ctx = work_table(shared.where("mixed").groupBy("kg", "ctx").agg(F.count("*").alias("n"), F.min(whole).alias("r")), "contexts")
    wanted = ctx.select("kg", "ctx", "n", "r.*")
    full = shared.where("not mixed").unionByName(shared.where("mixed").join(ctx.where("n > 1").select("kg", "ctx"), ["kg", "ctx"], "left_semi"))
    parts = [work_table(full.select("doc_id", "key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")), "whole-marks")]
    per = ctx.groupBy("kg").agg(F.count("*").alias("m"))
    entries, most = ctx.count(), per.agg(F.max("m")).first()[0] or 0
    if most > hot:
        big = per.where(F.col("m") > hot).select("kg")
        parts.append(work_table(hot_marks(docs, wanted.join(big, "kg", "left_semi"), length), "hot-marks"))
        wanted = wanted.join(big, "kg", "left_anti")
    if entries:
        parts.append(work_table(boundary_marks(docs, wanted, entries, length), "merge-marks"))
    marks = reduce(DataFrame.unionByName, parts)
    return work_table(marks.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("marks")), "marks")


def merged(marks) -> list[tuple[int, int]]:
    """Sorted ranges with those that touch joined."""
    out: list[list[int]] = []
    for m in () if marks is None else marks:
        if out and m["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], m["end"])
        else:
            out.append([m["start"], m["end"]])
    return [(a, b) for a, b in out]


def marked(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, str]:
    """``docs`` with a column of marks, null where nothing repeats, and that column's name."""
    small_batches(docs.sparkSession)
    k, i, m, out = (fresh(docs, x) for x in ("__k", "__i", "__m", "__marks"))
    marks = repeat_marks(docs, length, hot).select(F.col("doc_id").alias(i), F.col("key").alias(m), F.col("marks").alias(out))
    d = docs.withColumn(k, row_key())
    return d.join(marks, d["doc_id"].eqNullSafe(marks[i]) & (d[k] == marks[m]), "left").drop(k, i, m), out


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, marks in zip(*(batch.column(i) for i in range(3))):
                raw, cut = (text.as_py() or "").encode(), merged(marks.as_py())
                kept, at = [], 0
                for s, e in cut:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((doc.as_py(), len(raw), sum(e - s for s, e in cut), len(cut), hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d, marks = marked(docs.select("doc_id", "text"), length, hot)
    return d.select("doc_id", "text", marks).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (whole characters only) and ``n_chars`` counted anew; rows left with no text go."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(text)):
            if not text[i].is_valid:
                out.append(None)
                continue
            raw, kept, at = text[i].as_py().encode(), [], 0
            for s, e in merged(marks[i].as_py()):
                while s < e and raw[s] & 0xC0 == 0x80:
                    s += 1
                while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e -= 1
                kept.append(raw[at:s])
                at = e
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    cut = cut.asNondeterministic()  # else the filter and the column would each run it
    d, marks = marked(docs, length)
    left = fresh(d, "__left")
    d = d.withColumn(left, cut(F.when(F.col(marks).isNotNull(), F.col("text")), marks)).where(F.coalesce(F.length(left), F.lit(1)) > 0)
    size = F.when(F.col(left).isNotNull(), F.length(left).cast("long")).otherwise(F.col("n_chars"))
    new = {"n_chars": size.alias("n_chars"), "text": F.coalesce(F.col(left), F.col("text")).alias("text")}
    return d.select(*[new[c] if c in new else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
