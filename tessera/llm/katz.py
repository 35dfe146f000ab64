"""Operator 5: Katz backoff language model of words, order two, with Good-Turing discounts.

P(w | h) is ``d * c(h w) / c(h)`` for a pair seen in training and ``alpha(h) * P(w)`` else; P(w) is ``d * c(w) / N`` for a known word and else the mass that
discounting leaves, given to one unknown word.  Counts up to ``CUTOFF`` are discounted by Good-Turing.  ``alpha(h)`` makes each
context sum to one exactly; where discounts leave no mass, one is added to the denominator.  A token's score recurses from pair to word to the unknown word.
The first word's context is the start of a text, every text ends with the end token.

Tables are partitioned by hash.  Documents are turned into blocks of at most ``BLOCK_TOKENS`` tokens with their own dictionaries, written once; a block asks for
the counts of its distinct words and pairs and gets them back in its own order:

1. words: a block sends (hash, training count) of its words, split by hash; each part sums them over all blocks and answers with totals;
2. pairs: the same, about five bytes a pair (the high 56 bits of its hash); the answer also says which block owns a pair (the first that has it);
3. contexts: owners add up the word probabilities and count the pairs of each small count for each context; parts sum these and answer with alpha.

Blocks combine before they send, so a frequent word or pair costs one entry a block, whatever share of the corpus it has.

Defined cases: a null or empty text is one end token; a null id counts as the text '' for the hold-out rule; every row, repeated ones too, counts and is scored for itself, also where ids are equal; a very long text is a block of its own,
since a block ends after a whole document; scores depend on counts only, so no tie matters; other columns, whatever their names, are ignored; with no training tokens
all mass is the unknown word's; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, work_table
from tessera.llm.textkernel import Block, Hasher, U, blocks, lowered, mix

BLOCK_TOKENS = 500_000
PART_KEYS = 1_000_000
CUTOFF = 5
END, START = 0x1F3D5B79A2C4E681, 0x2E8A6C40F1B3D597


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def discounts(n: dict[int, int], cutoff: int = CUTOFF) -> np.ndarray:
    """Good-Turing discount ratio for counts 0..cutoff (0 unused); 1 where the counts of counts allow none."""
    out = np.ones(cutoff + 1)
    n1 = n.get(1, 0)
    if not n1:
        return out
    common = (cutoff + 1) * n.get(cutoff + 1, 0) / n1
    for r in range(1, cutoff + 1):
        if n.get(r, 0) and common < 1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common)
            if 0 < d < 1:
                out[r] = d
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.where(c < len(d), c, 0)]


class Words:
    """Word probabilities from counts, and the unknown word's."""

    def __init__(self, n: int, counts: dict[int, int], mass: float, d: np.ndarray):
        kept = mass
        self.d, self.total = d, float(n)
        if n - kept < 1e-9 * max(n, 1):
            self.total = n + 1.0
        self.unknown = 1.0 - kept / self.total if n else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unknown)


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte of rank, so that high bytes, mostly zero, compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def block_rows(batches, limit: int):
    """Rows of whole documents as token blocks: block, ids, held flags, token counts, dictionary (hashes, frequent first), local ids."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids, held, sizes, toks, n = [], [], [], [], 0

    def flush():
        nonlocal ids, held, sizes, toks, n, seq
        words, local, often = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, local = words[order], rank[local]
        row = pa.RecordBatch.from_arrays(
            [pa.array([(part << 24) + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(held, np.uint8).tobytes()], pa.binary()), pa.array([np.concatenate(sizes).astype("<u4").tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([planes(local)], pa.binary())],
            ["block", "ids", "held", "sizes", "words", "tokens"])
        seq += 1
        ids, held, sizes, toks, n = [], [], [], [], 0
        return row

    for batch in batches:
        for b in blocks(batch.column(1)):
            low = Block(lowered(b.data), b.off, b.first)
            start, end, first = low.words()
            h = Hasher(low.data)(start, end)
            count = np.diff(first) + 1
            out = np.empty(len(h) + low.n, U)
            last = np.cumsum(count) - 1
            inner = np.ones(len(out), bool)
            inner[last] = False
            out[inner], out[last] = h, END
            if n and n + len(out) > limit:
                yield flush()
            mine = batch.column(0).slice(b.first, b.n).to_pylist()
            ids += mine
            held += [held_out(i) for i in mine]
            sizes.append(count)
            toks.append(out)
            n += len(out)
    if n:
        yield flush()


class Tokens:
    """A block read back: local ids with the context of each token (START is local id ``len(words)``)."""

    def __init__(self, held: bytes, sizes: bytes, words: bytes, tokens: bytes):
        self.words = np.frombuffer(words, U)
        self.size = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.at = unplanes(tokens)
        self.first = np.cumsum(self.size) - self.size
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.train = np.repeat(~self.held, self.size)
        self.before = np.empty_like(self.at)
        self.before[1:] = self.at[:-1]
        self.before[self.first] = len(self.words)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs by (context, word) and the pair of each token."""
        return np.unique((self.before.astype(U) << U(32)) | self.at.astype(U), return_inverse=True)

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        h = np.append(self.words, U(START))
        a, b = h[(pairs >> U(32)).astype(np.int64)], h[(pairs & U(0xFFFFFFFF)).astype(np.int64)]
        return mix(mix(a) * U(3) + b)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def five(keys: np.ndarray) -> bytes:
    """The high seven bytes of sorted keys: steps of the first three as small numbers, the next four as they are."""
    return small(np.diff((keys >> U(40)).astype(np.int64), prepend=0)) + ((keys >> U(8)) & U(0xFFFFFFFF)).astype("<u4").tobytes()


def unfive(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    cut = len(raw) - 4 * n
    return (np.cumsum(unsmall(raw[:cut])).astype(U) << U(40)) | (np.frombuffer(raw[cut:], "<u4").astype(U) << U(8))


def small(c: np.ndarray) -> bytes:
    """Counts as bytes, those over 254 after them."""
    big = c[c > 254]
    return np.int64(len(c)).tobytes() + np.minimum(c, 255).astype(np.uint8).tobytes() + big.astype("<i8").tobytes()


def unsmall(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    out = np.frombuffer(raw[8 : 8 + n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[8 + n :], "<i8")
    return out


def rows_of(batch: pa.RecordBatch):
    """Rows as dicts, one in memory at a time."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}


ASK = "part int, block long, keys binary, counts binary"


def batch_of(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def split(block: int, keys: np.ndarray, counts: np.ndarray, parts: int, code) -> list[tuple]:
    """Requests of one block, in order of key, which is also the order of parts."""
    order = np.argsort(keys, kind="stable")
    edge = np.searchsorted(part_of(keys[order], parts), np.arange(parts + 1))
    return [(i, block, code(keys[order[a:b]]), small(counts[order[a:b]])) for i, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]


def totals(pdf: pd.DataFrame, decode) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Totals of distinct keys, the index of each entry, whether it is the first with its key, and the entries of each row."""
    keys = [decode(k) for k in pdf["keys"]]
    counts = np.concatenate([unsmall(c) for c in pdf["counts"]])
    _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(at, counts, len(first)).astype(np.int64)
    owner = np.zeros(len(at), bool)
    owner[first] = True
    return total, at, owner, [len(k) for k in keys]


def counted(requests: DataFrame, decode, name: str) -> DataFrame:
    """Answers (block, part, counts, owner bits) with totals over all blocks, and counts of counts in rows of block -1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        part = int(pdf["part"].iloc[0])
        total, at, owner, sizes = totals(pdf, decode)
        out, i = [], 0
        for block, n in zip(pdf["block"], sizes):
            out.append((block, part, small(total[at[i : i + n]]), np.packbits(owner[i : i + n]).tobytes()))
            i += n
        kinds = np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3)
        mass = [(total > 0).sum(), total.sum(), *kinds[1 : CUTOFF + 2]]
        out.append((-1, part, np.array(mass, "<i8").tobytes(), b""))
        return pd.DataFrame(out, columns=["block", "part", "counts", "owner"])

    return work_table(requests.groupBy("part").applyInPandas(run, "block long, part int, counts binary, owner binary"), name)


def statistics(answers: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Distinct seen, all occurrences, counts of counts.  One small row a part is added up in executors."""

    def add(batches):
        for pdf in batches:
            for raw in pdf["counts"]:
                yield pd.DataFrame([np.frombuffer(raw, "<i8")], columns=[f"s{i}" for i in range(CUTOFF + 3)])

    cols = [f"s{i}" for i in range(CUTOFF + 3)]
    r = answers.where("block = -1").select("counts").mapInPandas(add, ", ".join(f"{c} long" for c in cols)).agg(*[F.sum(c).alias(c) for c in cols]).first()
    r = [x or 0 for x in r]
    return r[0], r[1], {i + 1: r[2 + i] for i in range(CUTOFF + 1)}


def gathered(answers: DataFrame, alias: str, *cols: str) -> DataFrame:
    """One row a block with its answers of all parts."""
    return answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", *cols))).alias(alias))


def in_order(keys: np.ndarray, answers, decode) -> np.ndarray:
    """Answers of all parts put back in the block's order."""
    order = np.argsort(keys, kind="stable")
    got = np.concatenate([decode(a) for a in answers])
    out = np.empty(len(keys), got.dtype)
    out[order] = got
    return out


def bits(a) -> np.ndarray:
    return np.unpackbits(np.frombuffer(a["owner"], np.uint8))[: int(np.frombuffer(a["counts"][:8], "<i8")[0])].astype(bool)


def katz_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    blk = work_table(text.mapInArrow(lambda it: block_rows(it, block_tokens), "block long, ids array<long>, held binary, sizes binary, words binary, tokens binary"), "lm-blocks")
    size = blk.agg(F.sum(F.length("words") / 8), F.sum(F.length("tokens") / 4)).first()
    parts, pair_parts = (int(max(8, -(-(x or 0) // part_keys))) for x in size)
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    ask = ["part", "block", "keys", "counts"]

    def ask_words(batches):
        for batch in batches:
            for row in rows_of(batch):
                t = Tokens(row["held"], row["sizes"], row["words"], row["tokens"])
                yield batch_of(split(row["block"], t.words, np.bincount(t.at[t.train], minlength=len(t.words)), parts, lambda k: k.astype("<u8").tobytes()), ask, kinds)

    word = counted(blk.drop("ids").mapInArrow(ask_words, ASK), lambda k: np.frombuffer(k, "<u8").astype(U), "lm-words")
    vocab, total, kinds_of = statistics(word)
    d1 = discounts(kinds_of)
    mass = total - sum((1 - d1[r]) * r * kinds_of.get(r, 0) for r in range(1, CUTOFF + 1))
    p_word = Words(total, kinds_of, mass, d1)

    def ask_pairs(batches):
        for batch in batches:
            for row in rows_of(batch):
                t = Tokens(row["held"], row["sizes"], row["words"], row["tokens"])
                pairs, at = t.pairs()
                yield batch_of(split(row["block"], t.keys(pairs), np.bincount(at[t.train], minlength=len(pairs)), pair_parts, five), ask, kinds)

    pair = counted(blk.drop("ids").mapInArrow(ask_pairs, ASK), unfive, "lm-pairs")
    d2 = discounts(statistics(pair)[2])
    both = blk.join(gathered(word, "w", "counts"), "block").join(gathered(pair, "p", "counts", "owner"), "block")

    def read(row):
        t = Tokens(row["held"], row["sizes"], row["words"], row["tokens"])
        c1 = in_order(t.words, row["w"], lambda a: unsmall(a["counts"]))
        pairs, at = t.pairs()
        keys = t.keys(pairs)
        c2 = in_order(keys, row["p"], lambda a: unsmall(a["counts"]))
        return t, c1, pairs, at, keys, c2

    def ask_contexts(batches):
        for batch in batches:
            for row in rows_of(batch):
                t, c1, pairs, _, keys, c2 = read(row)
                own = in_order(keys, row["p"], bits) & (c2 > 0)
                h, w = (pairs[own] >> U(32)).astype(np.int64), (pairs[own] & U(0xFFFFFFFF)).astype(np.int64)
                c = c2[own]
                p = np.bincount(h, p_word(c1[w]), len(c1) + 1)
                sizes = [np.bincount(h, c, len(c1) + 1).astype(np.int64)] + [np.bincount(h[c == r], minlength=len(c1) + 1) for r in range(1, CUTOFF + 1)]
                ctx = np.append(t.words, U(START))
                order = np.argsort(ctx, kind="stable")
                edge = np.searchsorted(part_of(ctx[order], parts), np.arange(parts + 1))
                out = []
                for i, (a, b) in enumerate(zip(edge, edge[1:])):
                    if b > a:
                        k = order[a:b]
                        has = sizes[0][k] > 0
                        out.append((i, row["block"], ctx[k].astype("<u8").tobytes(), np.packbits(has).tobytes(), p[k][has].tobytes(), [small(x[k][has]) for x in sizes]))
                yield batch_of(out, ["part", "block", "keys", "has", "sums", "sizes"], kinds + [pa.binary(), pa.list_(pa.binary())])

    def alphas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [np.frombuffer(k, "<u8") for k in pdf["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        has = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)].astype(bool) for x, k in zip(pdf["has"], keys)]
        on = at[np.concatenate(has)]
        add = lambda xs: np.bincount(on, np.concatenate(xs), at.max() + 1)
        p, (n, *few) = add([np.frombuffer(x) for x in pdf["sums"]]), (add([unsmall(x[i]) for x in pdf["sizes"]]) for i in range(CUTOFF + 1))
        m = n - sum((1 - d2[r]) * r * x for r, x in enumerate(few, 1))
        short = (n > 0) & (n - m < 1e-9 * n)
        den = n + short
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(n > 0, (1 - m / den) / np.maximum(1 - p, 1e-300), 1.0)
        alpha = np.where(short, -alpha, alpha)
        out, i = [], 0
        for block, k in zip(pdf["block"], keys):
            out.append((block, int(pdf["part"].iloc[0]), alpha[at[i : i + len(k)]].astype("<f8").tobytes()))
            i += len(k)
        return pd.DataFrame(out, columns=["block", "part", "alpha"])

    sums = both.drop("ids").mapInArrow(ask_contexts, "part int, block long, keys binary, has binary, sums binary, sizes array<binary>")
    back = work_table(sums.groupBy("part").applyInPandas(alphas, "block long, part int, alpha binary"), "lm-contexts")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches):
        for batch in batches:
            for row in rows_of(batch):
                t, c1, pairs, at, _, c2 = read(row)
                alpha = in_order(np.append(t.words, U(START)), row["a"], lambda a: np.frombuffer(a["alpha"], "<f8"))
                h, w = (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64)
                starts = row["starts"]
                den = np.append(c1, starts)[h].astype(float) + (alpha[h] < 0)
                seen = np.where(c2 > 0, discounted(c2, d2) / np.maximum(den, 1.0), 0.0)
                with np.errstate(divide="ignore"):
                    logp = np.log10(np.where(c2 > 0, seen, np.abs(alpha[h]) * p_word(c1[w])))
                base = np.log10((c1 + 1.0) / (total + vocab + 1.0))
                add = lambda x: np.add.reduceat(x, t.first)
                n = len(t.size)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(t.held), pa.array(t.size), pa.array(add((c1[t.at] > 0).astype(np.int64))), pa.array(np.full(n, total, np.int64)), pa.array(add(base[t.at])), pa.array(add(logp[at]))], names)

    starts = blk.select(F.expr("aggregate(sequence(1, length(held)), 0L, (s, i) -> s + if(substring(held, i, 1) = x'00', 1, 0))").alias("n")).agg(F.sum("n")).first()[0] or 0
    ready = both.join(gathered(back, "a", "alpha"), "block").withColumn("starts", F.lit(starts).cast("long"))
    return ready.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
