"""Operator 7: quality classifier by co-training.

Two views of a document: its text (which words it has, and shape ratios) and its metadata (source, lang, length class).
Each view has a logistic classifier for "good" (quality 1 and not toxic).  In each of ``ROUNDS`` rounds both views judge one part of the unlabelled documents; over the rounds
the parts are all of them, in full.  The ``PER_ROUND`` most confident labels of each kind that one view gives join the training rows of the other.
Labelled rows held out of training then calibrate the two views together, and the combined probability scores every document, over its whole text.

The labelled sample is bounded: the ``MAX_LABELLED`` documents with the smallest hashes of their ids.  Judging runs in executors: a task keeps its own most confident rows, and Spark merges
those, so the driver gets at most ``4 * PER_ROUND`` identities and feature rows a round.  The fitted model has a fixed size (``BUCKETS`` weights) whatever the corpus, and is broadcast.
What is held out, the order of training rows and all ties follow hashes of id and text, so the layout of the files changes nothing.

Defined cases: a null text is empty; a null source or lang is a value of its own; labels with nulls are not used; of several labels of one id the lowest quality and
highest toxicity hold, for all rows with that id (of which the sample takes those with the smallest hashes); a document with a null id has no label; repeated rows get equal scores; a very long text is read whole, in a block of its own; without labels of both kinds every
document scores 0.5 and is kept; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import row_key, small_batches, work_table
from tessera.llm.textkernel import Block, Hasher, U, blocks, lowered, lut, mix

MAX_LABELLED, ROUNDS, HOLD = 6_000, 3, 5
BUCKETS = 1 << 18
MIN_Z, MIN_DF, CONFIDENT, PER_ROUND, THRESHOLD = 4.0, 5, 0.98, 500, 0.5
GROUPS = (b"#*$%&|<>", b"!?", bytes(range(65, 91)), b"0123456789")
WORD = lut(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
STEPS = (0.02, 0.1, 0.3)
PREFIXES = (5, 6, 7)
SHORT = (5, 10, 20, 40, 80)


def text_view(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash bucket of each run of letters and digits, and of its starts of ``PREFIXES`` bytes; shape features of each document."""
    inside = WORD[b.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[b.off] = True
    prev, nxt = np.zeros_like(inside), np.zeros_like(inside)
    prev[1:], nxt[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~prev | edge[:-1]))
    end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
    h = Hasher(lowered(b.data))
    doc, docs, hashes = np.searchsorted(b.off, start, "right") - 1, [], []
    for size in PREFIXES:
        on = end - start > size
        docs.append(doc[on])
        hashes.append(h(start[on], start[on] + size) + U(size))
    word = h(start, end)
    size = np.maximum(b.counts(~lut(b" \t\n\r\x0b\x0c")[b.data]), 1)
    words = np.bincount(doc, minlength=b.n)
    again = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=b.n)
    shape = [b.counts(lut(g)[b.data]) > s * size for g in GROUPS for s in STEPS] + [again > s * words for s in STEPS] + [words < s for s in SHORT]
    return np.concatenate([doc, *docs]), (np.concatenate([word, *hashes]) % U(BUCKETS)).astype(np.int64), np.stack(shape, 1)


def meta_buckets(source, lang, n_bytes: np.ndarray) -> np.ndarray:
    """Three hash buckets a document."""
    import zlib

    code = lambda kind, xs: np.array([zlib.crc32(f"{kind}\x00{x!r}".encode()) for x in xs], np.int64) % BUCKETS
    size = np.floor(np.log2(np.maximum(n_bytes, 1))).astype(int).tolist()
    return np.stack([code("source", source), code("lang", lang), code("size", size)], 1)


def shape_buckets() -> np.ndarray:
    n = (len(GROUPS) + 1) * len(STEPS) + len(SHORT)
    return (mix(np.arange(1, n + 1, dtype=U)) % U(BUCKETS)).astype(np.int64)


class View:
    """Logistic model over bucket sets, kept dense over all buckets."""

    def __init__(self):
        self.weight, self.bias = np.zeros(BUCKETS, np.float32), 0.0

    def logit(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weight[bucket], n) + self.bias

    def fit(self, row: np.ndarray, bucket: np.ndarray, y: np.ndarray, steps: int = 300) -> "View":
        """Buckets whose rate differs between the classes by ``MIN_Z`` standard errors, then gradient steps on those."""
        n, pos = len(y), y.sum()
        df = np.bincount(bucket, minlength=BUCKETS).astype(float)
        hit = np.bincount(bucket, y[row], BUCKETS)
        rate = pos / n
        z = (hit - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate), 1e-9))
        use = (df >= MIN_DF) & (np.abs(z) >= MIN_Z)
        self.weight[:] = 0
        self.bias = float(np.log((pos + 1) / (n - pos + 1)))
        on = use[bucket]
        row, bucket = row[on], bucket[on]
        w, b, gw, gb = np.zeros(BUCKETS), self.bias, np.full(BUCKETS, 1e-6), 1e-6
        ids = np.unique(bucket)
        for _ in range(steps if len(ids) else 0):
            g = (1 / (1 + np.exp(-(np.bincount(row, w[bucket], n) + b))) - y) / n
            d = np.bincount(bucket, g[row], BUCKETS)[ids] + 1e-5 * w[ids]
            gw[ids] += d * d
            gb += g.sum() ** 2
            w[ids] -= 0.5 * d / np.sqrt(gw[ids])
            b -= 0.5 * g.sum() / np.sqrt(gb)
        self.weight, self.bias = w.astype(np.float32), float(b)
        return self


def _take(ptr: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = ptr[rows + 1] - ptr[rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ptr[rows], size)
    return row, flat[at]


FEATURES = "y int, h long, text binary, meta binary"


def order_key() -> F.Column:
    """What orders documents: a hash of id and text."""
    return F.xxhash64(F.lit("co-training"), F.col("doc_id"), row_key())


def features(docs: DataFrame) -> DataFrame:
    """Label, order key and both views' buckets of each row of docs(y, h, source, lang, text)."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(4)):
                part = batch.slice(b.first, b.n)
                doc, bucket, shape = text_view(b)
                sdoc, which = np.nonzero(shape)
                pair = np.unique(np.concatenate([doc * BUCKETS + bucket, sdoc * BUCKETS + shape_buckets()[which]]))
                edge = np.searchsorted(pair, np.arange(b.n + 1) * BUCKETS)
                ids = (pair % BUCKETS).astype("<u4")
                meta = meta_buckets(part.column(2).to_pylist(), part.column(3).to_pylist(), np.diff(b.off)).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([ids[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())], ["y", "h", "text", "meta"])

    return docs.select("y", "h", "source", "lang", F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, FEATURES)


def logits(b: Block, source: list, lang: list, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Both views' logits of each document of a block; each depends on its own document only, to the last bit."""
    weight, bias, meta_weight, meta_bias = model
    doc, bucket, shape = text_view(b)
    on = weight[bucket] != 0
    pair = np.unique(doc[on] * BUCKETS + bucket[on])
    t = np.bincount(pair // BUCKETS, weight[pair % BUCKETS], b.n) + (shape * weight[shape_buckets()].astype(float)).sum(1) + bias
    return t, meta_weight[meta_buckets(source, lang, np.diff(b.off))].astype(float).sum(1) + meta_bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Rows:
    """Feature rows in order of their keys, as flat arrays a view."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: (r["h"], r["meta"], r["text"], r["y"]))
        self.n, self.y, self.h = len(rows), np.array([r["y"] for r in rows], float), np.array([r["h"] for r in rows], np.int64)
        self.views = []
        for name in ("text", "meta"):
            parts = [np.frombuffer(r[name], "<u4") for r in rows]
            self.views.append((np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate([*parts, np.zeros(0, "<u4")]).astype(np.int32)))

    def take(self, view: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _take(*self.views[view], rows)


class Model:
    def __init__(self):
        self.text, self.meta, self.mixed = View(), View(), (0.0, 0.0, 0.0)

    @property
    def weights(self) -> tuple:
        return self.text.weight, self.text.bias, self.meta.weight, self.meta.bias


def fit_view(view: View, kind: int, sets: list[tuple[Rows, np.ndarray]]) -> None:
    """Fit on rows of several tables together."""
    row, bucket, y, n = [], [], [], 0
    for rows, at in sets:
        r, b = rows.take(kind, at)
        row.append(r + n)
        bucket.append(b)
        y.append(rows.y[at])
        n += len(at)
    view.fit(np.concatenate(row), np.concatenate(bucket), np.concatenate(y))


def co_train(labelled: Rows, exchange, rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows; those whose key ``HOLD`` divides only calibrate.

    ``exchange(step, model)`` gives the rows that the text view and the metadata view are surest of in part ``step`` of the unlabelled documents, labelled by them.
    """
    model = Model()
    held = labelled.h % HOLD == 0
    hold, train = np.flatnonzero(held), np.flatnonzero(~held)
    if len(set(labelled.y[train])) < 2 or len(set(labelled.y[hold])) < 2:
        return model
    sets = [[(labelled, train)], [(labelled, train)]]
    for step in range(rounds + 1):
        fit_view(model.text, 0, sets[0])
        fit_view(model.meta, 1, sets[1])
        if step < rounds:
            for view, rows in enumerate(exchange(step, model)):
                sets[1 - view].append((rows, np.arange(rows.n)))
    x = np.stack([v.logit(*labelled.take(i, hold), len(hold)) for i, v in enumerate((model.text, model.meta))] + [np.ones(len(hold))], 1)
    start = np.array([1.0, 0.0, 0.0])
    w, y = start.copy(), labelled.y[hold]
    for _ in range(50):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * (w - start))
    model.mixed = tuple(map(float, w))
    return model


def sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y) of the labelled documents with the smallest hashes."""
    lab = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    lab = lab.select("doc_id", F.when((F.col("q") > 0) & (F.col("x") <= 0), 1).otherwise(0).alias("y"))
    return work_table(lab.orderBy(F.xxhash64(F.lit("labels"), "doc_id"), "doc_id").limit(most), "labelled")


SURE = "view int, good int, p double, h long, doc_id long, key long"


def surest(pool: DataFrame, model: tuple, per: int, confident: float) -> DataFrame:
    """Each task's ``per`` most confident rows of each view and label."""
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        best: dict = {}
        for batch in batches:
            for b in blocks(batch.column(5)):
                part = batch.slice(b.first, b.n)
                doc, key, h = part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()
                for view, x in enumerate(logits(b, part.column(3).to_pylist(), part.column(4).to_pylist(), shared.value)):
                    p = sigmoid(x)
                    for good in (0, 1):
                        q = p if good else 1 - p
                        mine = best.setdefault((view, good), [])
                        mine += [(-q[i], int(h[i]), doc[i] is None, doc[i], int(key[i])) for i in np.flatnonzero(q >= confident).tolist()]
                        if len(mine) > 4 * per:
                            mine.sort(key=lambda r: r[:3])
                            del mine[per:]
        for (view, good), rows in best.items():
            rows = sorted(rows, key=lambda r: r[:3])[:per]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array([view] * len(rows), pa.int32()), pa.array([good] * len(rows), pa.int32()), pa.array([-float(q) for q in cols[0]]), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[3]), pa.int64()), pa.array(list(cols[4]), pa.int64())], ["view", "good", "p", "h", "doc_id", "key"])

    return pool.select("doc_id", row_key().alias("key"), "h", "source", "lang", F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, SURE)


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, per: int = PER_ROUND, confident: float = CONFIDENT) -> Model:
    """Labelled sample and exchanged rows as features; every pass over the unlabelled documents runs in executors."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", "lang", "text").withColumn("h", order_key())
    chosen = sample(labels, max_labelled)
    rows = Rows(features(d.join(F.broadcast(chosen), "doc_id")).orderBy("h", "meta", "text").limit(max_labelled).collect())
    free = d.join(F.broadcast(chosen.select(F.col("doc_id").alias("__i"))), F.col("doc_id") == F.col("__i"), "left_anti")

    def exchange(step: int, model: Model):
        part = free.where(F.pmod("h", F.lit(rounds)) == step)
        sure = work_table(surest(part, model.weights, per, confident), "sure")
        out = []
        for view in (0, 1):
            picks = [r for good in (0, 1) for r in sure.where((F.col("view") == view) & (F.col("good") == good)).orderBy(F.desc("p"), "h", F.col("doc_id").isNull(), "doc_id").limit(per).collect()]
            ids = spark.createDataFrame([(r["doc_id"], r["key"], r["good"]) for r in picks], "__i long, __k long, y int").distinct()
            hits = part.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__i"))).where(row_key() == F.col("__k"))
            out.append(Rows(features(hits).orderBy("h", "meta", "text", "y").limit(2 * per).collect()))
        return out

    return co_train(rows, exchange, rounds)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, text_logit, meta_logit, score, kept of every document."""
    small_batches(docs.sparkSession)
    fit = fitted(docs, labels, max_labelled, **how)
    model = docs.sparkSession.sparkContext.broadcast((fit.weights, fit.mixed))

    def run(batches):
        weights, (a, c, d) = model.value
        for batch in batches:
            for b in blocks(batch.column(3)):
                part = batch.slice(b.first, b.n)
                t, meta = logits(b, part.column(1).to_pylist(), part.column(2).to_pylist(), weights)
                p = sigmoid(a * t + c * meta + d)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t), pa.array(meta), pa.array(p), pa.array(p >= threshold)], ["doc_id", "text_logit", "meta_logit", "score", "kept"])

    return docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, "doc_id long, text_logit double, meta_logit double, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
