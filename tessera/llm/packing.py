"""Operator 9: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents.  A round fills one window (one sequence): every source's deficit grows by its share of the window, the sources owed most are
visited first and send whole documents while their deficit covers them, and what they send is taken off.  Deficits are carried to the next window.  A document of at most
one window goes as a whole where it fits; a longer one is sent in packets of ``PACKET`` tokens.  Where no head fits into the room left, the source owed most sends the largest of its
next ``LOOK`` documents that does; else the head is cut to the room, and its rest comes next, so no window has padding.

Target proportions are the sources' own shares of all tokens, or ``targets``.  A queue that ends leaves its share to the others.

Partitions: a source's documents stand in its queue in order of partition and row, so sums by (partition, source) give each document its place.  A place over the target is the virtual time at
which an ideal mix serves it; equal slices of the ideal mix's tokens are chunks of about ``CHUNK`` tokens, and each chunk is one group.  A chunk's first place of a source says what
the chunks before sent of it, and its virtual time what was due by then: the difference is the deficit it starts with.  So deficits pass across partitions
without any task waiting for another (a chunk serves its last documents to their ends, so at its edge a source is off by up to one document), and a source with a third of all tokens is spread over all chunks.  The end of a chunk goes out in sequences whose sizes are powers of two, unpadded.

Defined cases: a null or empty text is one end token; a null source is a queue of its own; rows with equal ids, and equal rows, are separate documents in their own places (ties keep the order of rows);
a text longer than many windows spans them, one task holds the ids of one document and one chunk; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import string
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import small_batches, work_table
from tessera.llm.textkernel import Hasher, U, lowered

SEQUENCE, END_ID = 2048, 1
CHUNK, PACKET, LOOK = 1 << 19, 512, 64
MAX_TARGETS = 1000
MAX_BROADCAST = 500_000
CACHE_WORDS = 500_000
BATCH_BYTES = 2 << 20
MARKS = "".join(c for c in string.punctuation if c != "'")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Byte classes of a text: a separator, a letter, a mark, a digit, anything else.
SEPARATOR, LETTER, MARK, DIGIT, OTHER = range(5)
SPACES = b" \n\t\r"


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the ranges from ``start``, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


class WordMerger:
    """Byte-pair merges of many words at once, from the tokenizer's own vocabulary and merge list.

    Every step joins, in each unfinished word, the leftmost pair of the lowest rank; finished words leave the arrays.
    """

    SLOTS = 1 << 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        char = [chr(hidden.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in char], np.uint32)
        self.last = np.array([vocab[c + end] for c in char], np.uint32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.out = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.none = len(pairs)
        self.keys = np.full(self.SLOTS, np.iinfo(np.uint32).max, np.uint32)
        self.rank = np.full(self.SLOTS, self.none, np.int32)
        for r, (a, b) in enumerate(pairs):
            k = vocab[a] << 16 | vocab[b]
            at = int(self._slot(np.array([k], np.uint32))[0])
            while self.keys[at] != np.iinfo(np.uint32).max and self.keys[at] != k:
                at = (at + 1) % self.SLOTS
            if self.keys[at] != k:
                self.keys[at], self.rank[at] = k, r

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint32(2654435769)) >> np.uint32(14)).astype(np.int64)

    def _ranks(self, k: np.ndarray) -> np.ndarray:
        at = self._slot(k)
        got = self.rank[at]
        open_ = np.flatnonzero((self.keys[at] != k) & (got != self.none))
        got[open_] = self.none
        while len(open_):
            at[open_] = (at[open_] + 1) % self.SLOTS
            there = self.keys[at[open_]]
            hit = there == k[open_]
            got[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (there != np.iinfo(np.uint32).max)]
        return got

    def __call__(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and their number in each, for words of ``size`` bytes in ``data``."""
        ids = self.inner[data]
        ends = np.cumsum(size)
        ids[ends - 1] = self.last[data[ends - 1]]
        name, done = np.arange(len(size)), []
        while len(name):
            start = np.cumsum(size) - size
            key = np.full(len(ids), np.iinfo(np.uint32).max, np.uint32)
            key[:-1] = ids[:-1] << np.uint32(16) | ids[1:]
            rank = self._ranks(key)
            rank[start + size - 1] = self.none
            best = np.minimum.reduceat(rank, start)
            going = best < self.none
            if not going.all():
                keep = np.repeat(going, size)
                done.append((name[~going], size[~going], ids[~keep]))
                ids, rank, name, size, best = ids[keep], rank[keep], name[going], size[going], best[going]
                if not len(name):
                    break
            word = np.repeat(np.arange(len(name)), size)
            at = np.flatnonzero(rank == best[word])
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            at = at[first]
            ids[at] = self.out[best]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, size = ids[keep], size - 1
        name, size, ids = (np.concatenate([d[i] for d in done]) for i in range(3))
        start, order = np.cumsum(size) - size, np.argsort(name)
        return ids[ragged(start[order], size[order])], size[order]


#: The rules that ``Encoder`` follows: normalizers, the pattern that parts words, the model's marks; ids lie below 2**16.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def has_known_rules(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, parts = d["model"], (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, level = parts[0], parts[-1]
    return (
        (d.get("normalizer") or {}).get("normalizers") == NORMALIZERS and len(parts) == 2 and (split.get("pattern") or {}).get("Regex") == PATTERN and split.get("behavior") == "Removed" and split.get("invert") is True
        and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and max(model["vocab"].values()) < 1 << 16 and 2 * len(model["merges"]) <= WordMerger.SLOTS
    )


class LibraryEncoder:
    """Ids of whole texts by the library, for a tokenizer of any rules."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``Encoder``: ids of all texts, each with the end token, and their number in each."""
        got = [np.array([*e.ids, END_ID], np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(got or [np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)


class Encoder:
    """Ids of whole texts.

    The tokenizer ignores case, treats text between spaces on its own, and parts letters, marks and single digits.  Words of ASCII and Latin-1 letters, ASCII digits and marks without an apostrophe are
    parted here by the same rule; any other word goes to the tokenizer as it is, and so does a whole text with an added token's string.
    Pieces are looked up by 64-bit hash in a bounded table, and only new ones are encoded.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.merge, self.cache = Tokenizer.from_file(path), WordMerger(path), cache
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.full(256, OTHER, np.uint8)
        for kind, chars in ((SEPARATOR, SPACES), (LETTER, string.ascii_letters.encode()), (MARK, MARKS.encode()), (DIGIT, string.digits.encode())):
            self.kind[list(chars)] = kind
        self._learnt(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    @classmethod
    def of_worker(cls, path: str) -> "Encoder | LibraryEncoder":
        """One encoder a worker process, so that tasks share its table; the library's own for a tokenizer of other rules."""
        state = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
        if path not in state:
            state[path] = cls(path) if has_known_rules(path) else LibraryEncoder(path)
        return state[path]

    def _learnt(self, keys, at, size, pool) -> None:
        self.keys, self.at, self.size, self.pool = keys, at, size, pool

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of known pieces, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _parted(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes; starts, ends of pieces; which of them the tokenizer must see."""
        low, kind = lowered(data), self.kind[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        fine = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[fine], after[fine]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(after <= 0x9E, after + 0x20, after)
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind != SEPARATOR
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        odd = np.flatnonzero(kind == OTHER)
        bad = np.unique(np.searchsorted(start, odd, "right") - 1)
        kind[ragged(start[bad], end[bad] - start[bad])] = OTHER
        before, behind = np.zeros_like(kind), np.zeros_like(kind)
        before[1:], behind[:-1] = kind[:-1], kind[1:]
        some, digit = kind != SEPARATOR, kind == DIGIT
        start, end = np.flatnonzero(some & ((before != kind) | digit)), np.flatnonzero(some & ((behind != kind) | digit)) + 1
        return low, start, end, kind[start] == OTHER

    def _learn(self, low, keys, start, end, odd) -> None:
        """Encode new pieces and add them to the table."""
        easy = ~odd
        size = (end - start)[easy]
        ids, n = self.merge(low[ragged(start[easy], size)], size) if easy.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        words = [low[a:b].tobytes().decode() for a, b in zip(start[odd], end[odd])]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        pool = np.concatenate([self.pool, ids, np.fromiter((i for e in rest for i in e), np.uint32)]).astype(np.uint32)
        n = np.concatenate([n, np.array([len(e) for e in rest], np.int64)])
        k = np.concatenate([self.keys, keys[easy], keys[odd]])
        at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
        order = np.argsort(k)
        self._learnt(k[order], at[order], np.concatenate([self.size, n])[order], pool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end token, and their number in each."""
        n = len(texts)
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring(texts, self.added[0], ignore_case=True) if self.added else pa.array([False] * n)
        for a in self.added[1:]:
            whole = pc.or_(whole, pc.match_substring(texts, a, ignore_case=True))
        none, gap = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        plain = pc.binary_join_element_wise(pc.if_else(whole, none, texts), gap, none)
        off = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1]
        data = np.frombuffer(plain.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        low, start, end, odd = self._parted(data)
        keys = Hasher(low)(start, end)
        uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = self._find(uniq)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.keys) + len(new) > self.cache:
                # the pieces of these texts stay
                old = at[at >= 0]
                size = self.size[old]
                self._learnt(self.keys[old], np.cumsum(size) - size, size, self.pool[ragged(self.at[old], size)])
            self._learn(low, uniq[new], start[first[new]], end[first[new]], odd[first[new]])
            at = self._find(uniq)
        at = at[inverse]
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, off)]
        count = np.diff(upto) + 1
        ids = self.pool[ragged(self.at[at], size)] if len(at) else np.zeros(0, np.uint32)
        out = np.full(len(ids) + n, END_ID, np.uint32)
        mine = np.ones(len(out), bool)
        mine[np.cumsum(count) - 1] = False
        out[mine] = ids
        hits = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        if not hits:
            return out, count
        parts = np.split(out, np.cumsum(count)[:-1])
        for i in hits:
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids + [END_ID], np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts])


def slices(size: np.ndarray, limit: int):
    """Runs of rows of at most ``limit`` bytes, or one row."""
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + limit, "right")))
        yield i, j
        i = j


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """part, place (tokens before it in its source within the part), doc_id, source, n, ids (16 or 32 bits each)."""

    def run(batches):
        from pyspark import TaskContext

        encode, part, before = Encoder.of_worker(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            source, text = batch.column(1).to_pylist(), batch.column(2)
            size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in slices(size, BATCH_BYTES):
                b, place = batch.slice(lo, hi - lo), []
                got, n = encode(text.slice(lo, hi - lo))
                for s, m in zip(source[lo:hi], n.tolist()):
                    place.append(before.get(s, 0))
                    before[s] = place[-1] + m
                got = got.astype("<u2") if got.max() < 65536 else got.astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n * got.itemsize)]).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(got.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64()), b.column(0), b.column(1), pa.array(n, pa.int64()), ids], ["part", "place", "doc_id", "source", "n", "ids"])

    return docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, "part int, place long, doc_id long, source string, n long, ids binary")


def packet(left: int, size: int) -> int:
    """Tokens that go together of a document with ``left`` to send: all, unless it is longer than a window."""
    return left if left <= size else min(PACKET, size)


def round_robin(tokens: list[int], source: list[int], share: np.ndarray, deficit: np.ndarray, size: int = SEQUENCE) -> list[list[int]]:
    """Pieces (document, start, length, window, offset) of one chunk.

    ``tokens`` and ``source`` are of its documents in the order of the queues; ``share`` and the ``deficit`` to start with are of its sources.
    """
    queues: list[list[int]] = [[] for _ in share]
    for i in range(len(tokens) - 1, -1, -1):
        queues[source[i]].append(i)
    left, done, out = list(tokens), [0] * len(tokens), []
    head = np.array([packet(left[q[-1]], size) if q else 0 for q in queues])
    owed, window, room = deficit.astype(float), 0, size

    def send(s: int, k: int, m: int) -> None:
        """``m`` tokens of the document ``k`` places behind the head of a queue."""
        nonlocal room
        q = queues[s]
        i = q[-1 - k]
        if out and out[-1][0] == i and out[-1][3] == window:
            out[-1][2] += m
        else:
            out.append([i, done[i], m, window, size - room])
        done[i] += m
        left[i] -= m
        room -= m
        owed[s] -= m
        if not left[i]:
            del q[-1 - k]
        head[s] = packet(left[q[-1]], size) if q else 0

    while (on := head > 0).any():
        owed[on] += size * share[on] / share[on].sum()
        due = np.flatnonzero(on & (head <= owed))
        for s in due[np.argsort(-owed[due], kind="stable")].tolist():
            while 0 < head[s] <= owed[s] and head[s] <= room:
                send(s, 0, int(head[s]))
        while room and (on := head > 0).any():
            s = int(np.argmax(np.where(on, owed, -np.inf)))
            if head[s] > room and owed[s] < size:
                fit = on & (head <= room)
                if fit.any():
                    s = int(np.argmax(np.where(fit, owed, -np.inf)))
            if head[s] <= room:
                send(s, 0, int(head[s]))
                continue
            near = [(left[i], -k) for k, i in enumerate(queues[s][: -LOOK - 1 : -1]) if left[i] <= room and not done[i]]
            if near:
                n, k = max(near)
                send(s, -k, n)
            else:
                send(s, 0, room)
        window, room = window + 1, size
    return in_powers(out, window - 1, size)


def in_powers(pieces: list[list[int]], last: int, size: int) -> list[list[int]]:
    """The last window, if it is not full, as sequences whose sizes are powers of two."""
    tail = [p for p in pieces if p[3] == last]
    fill = sum(p[2] for p in tail)
    if not tail or fill == size:
        return pieces
    out = pieces[: len(pieces) - len(tail)]
    edges = [0]
    for bit in range(size.bit_length() - 1, -1, -1):
        if fill >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    for i, start, n, _, offset in tail:
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            x, y = max(a, offset), min(b, offset + n)
            if x < y:
                out.append([i, start + x - offset, y - x, last + k, x - a])
    return out


class Ideal:
    """The mix that serves every source its share at every moment: tokens served by virtual time, and back.

    Named sources have their own shares; all others have their share of all tokens, and so end together.
    """

    def __init__(self, total: int, named: dict, lengths: dict):
        self.named = {s: (float(w), int(lengths.get(s, 0))) for s, w in named.items()}
        self.rest, self.total = total - sum(n for _, n in self.named.values()), total
        self.times = np.array(sorted({0.0, float(max(total, 1)), *(n / w for w, n in self.named.values())}))
        self.served = np.array([self.by(t) for t in self.times])

    def by(self, t: float) -> float:
        return self.rest * min(1.0, t / max(self.total, 1)) + sum(min(n, w * t) for w, n in self.named.values())

    def column(self, t: F.Column) -> F.Column:
        out = F.lit(float(self.rest)) * F.least(F.lit(1.0), t / F.lit(float(max(self.total, 1))))
        for w, n in self.named.values():
            out = out + F.least(F.lit(float(n)), F.lit(w) * t)
        return out

    def when(self, tokens: float) -> float:
        return float(np.interp(tokens, self.served, self.times))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, with_ids: bool = False, targets: dict | None = None, chunk: int = CHUNK) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds the ids themselves.  ``targets`` gives shares in (0, 1] of at most ``MAX_TARGETS`` sources; the others keep their own."""
    named = dict(targets or {})
    if len(named) > MAX_TARGETS or any(not 0 < w <= 1 for w in named.values()):
        raise ValueError(f"targets: at most {MAX_TARGETS} shares in (0, 1]")
    small_batches(docs.sparkSession)
    tokens = work_table(encoded(docs, tokenizer or default_tokenizer()), "tokens")
    sums = work_table(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "token-sums")
    queues = sums.groupBy("source").agg(F.sum("n").alias("length"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    wanted = [s for s in named if s is not None]
    lengths = {r[0]: r[1] for r in queues.where(F.col("source").isin(wanted) | (F.col("source").isNull() & F.lit(None in named))).collect()} if named else {}
    ideal = Ideal(total, named, lengths)
    share = F.col("length") / F.lit(float(max(total, 1)))
    for s, w in named.items():
        share = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(share)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({"part": "__p", "source": "__s"}).drop("n")
    base = base.join(queues.withColumn("share", share), base["__s"].eqNullSafe(F.col("source"))).select("__p", "__s", "base", "length", "share")
    if sums.count() <= MAX_BROADCAST:
        base = F.broadcast(base)
    placed = tokens.join(base, (tokens["part"] == base["__p"]) & tokens["source"].eqNullSafe(base["__s"])).withColumn("start", F.col("base") + F.col("place"))
    placed = placed.withColumn("chunk", F.floor(ideal.column(F.col("start") / F.col("share")) / F.lit(float(chunk))))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    kinds = [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        code = pc.rank(t.column("source"), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy() - 1
        start, n = t.column("start").to_numpy(), t.column("n").to_numpy()
        order = np.lexsort((start, code))
        code, start, n = code[order], start[order], n[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        share, length = (t.column(c).to_numpy()[order][first] for c in ("share", "length"))
        number = t.column("chunk")[0].as_py()
        due = np.minimum(length, share * ideal.when(number * float(chunk)))
        raw, doc = t.column("ids"), t.column("doc_id").to_pylist()
        out, parts, at, held = [], [], -1, b""
        for i, a, m, window, offset in sorted(round_robin(n.tolist(), code.tolist(), share, due - start[first], size)):
            if i != at:
                at, held = i, raw[int(order[i])].as_py()
                if len(held) != 4 * n[i]:
                    held = np.frombuffer(held, "<u2").astype("<u4").tobytes()
            part = held[4 * a : 4 * (a + m)]
            out.append((doc[order[i]], a, m, zlib.crc32(part), int(n[i]), (number << 32) + window, offset))
            if with_ids:
                parts.append(part)
        cols = [pa.array(list(c), pa.int64()) for c in zip(*out)]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(cols[2].to_numpy())]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
        return pa.Table.from_arrays([c.cast(k) for c, k in zip(cols, kinds)], names)

    schema = ", ".join(f"{c} long" for c in names[:7]) + (", ids array<int>" if with_ids else "")
    return placed.select("chunk", "doc_id", "source", "start", "n", "length", "share", "ids").groupBy("chunk").applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
