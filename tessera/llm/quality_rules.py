"""Operator 1: quality rules as a short-circuit cascade.

Every document gets the base measures of its text in one Arrow pass.  Documents that pass the
base rule then meet the cascade: each rule does its own work on what the rules before it left, and on nothing else.
The order is greedy on a sample of about ``SAMPLE_ROWS`` rows, taken where they lie: next comes the rule with the most rejections among the sampled documents that the
rules before it leave, per second of its cost.  It changes the work, never the verdict, since a document is kept only if no rule rejects it.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; rows are judged one by one, so
repeated rows get equal verdicts; rules with equal rates keep their listed order; a null id stays null; a very long text is judged whole, in a block of its own; extra columns, whatever their names, are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.textkernel import WHITE, Block, Hasher, U, blocks, lut, mix, repeated

WINDOW = 8
MIN_WORDS = 20
SAMPLE_ROWS = 2000
SYMBOLS = lut(b"#*$%&|<>")
#: How list lines begin and cut lines end.
BULLETS = (b"-", b"*", "•".encode())
ELLIPSES = (b"...", "…".encode())


def measures(b: Block) -> dict[str, np.ndarray]:
    """Base measures of each document of a block."""
    start, end, first = b.words()
    n_words = np.diff(first)
    h = Hasher(b.data)
    lead = ((b.data & 0xC0) != 0x80).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(lead)])
    per_word = np.concatenate([[0], np.cumsum(chars[end] - chars[start])])
    word_chars = per_word[first[1:]] - per_word[first[:-1]]
    ls, le, ldoc = b.lines()
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, ldoc = ls[full], le[full], ldoc[full]
    lines = np.bincount(ldoc, minlength=b.n)
    keys = np.unique(np.stack([ldoc.astype(U), h(ls, le)], 1), axis=0) if len(ls) else np.zeros((0, 2), U)
    dup_lines = lines - np.bincount(keys[:, 0].astype(np.int64), minlength=b.n)
    doc = np.repeat(np.arange(b.n), n_words)
    covered = np.zeros(b.n, np.int64)
    if (m := len(start) - WINDOW + 1) > 0:
        wh = h(start, end)
        key = np.zeros(m, U)
        for j in range(WINDOW):
            key = mix(key + wh[j : j + m])
        inside = doc[:m] == doc[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        again = at[repeated(mix(key[at] + doc[at].astype(U) * U(0x9E3779B97F4A7C15)))]
        if len(again):
            step = np.zeros(len(start) + 1, np.int64)
            np.add.at(step, again, 1)
            np.add.at(step, again + WINDOW, -1)
            covered = np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=b.n)
    return {"words": (start, end, first), "n_words": n_words, "word_chars": word_chars, "n_symbols": b.counts(SYMBOLS[b.data]), "n_dup_lines": dup_lines, "n_repeat_words": covered, "n_lines": lines}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a block, its measures and the positions still alive; it returns a mask over those."""

    name: str
    rejects: Callable[[Block, dict, np.ndarray], np.ndarray]


def _symbols(b, m, at):
    return 10 * m["n_symbols"][at] > 3 * m["n_words"][at]


def _lines(b, m, at):
    return 10 * m["n_dup_lines"][at] > 3 * m["n_lines"][at]


def _word_length(b, m, at):
    chars, words = m["word_chars"][at], m["n_words"][at]
    return (chars < 2 * words) | (chars > 20 * words)


def _each(b: Block, at: np.ndarray, chars: bytes) -> np.ndarray:
    """Occurrences of some ASCII characters in each document still alive, by deleting them."""
    return np.array([len(t) - len(t.translate(None, chars)) for t in map(b.text, at)], np.int64)


def _shouting(b, m, at):
    return 10 * _each(b, at, b"!?") > 3 * m["n_words"][at]


def _digits(b, m, at):
    return 2 * _each(b, at, b"0123456789") > m["word_chars"][at]


def _capitals(b, m, at):
    return 2 * _each(b, at, bytes(range(65, 91))) > m["word_chars"][at]


def _full_lines(b: Block, i: int) -> list[bytes]:
    """Lines of a document that hold a word, without white space at their ends."""
    return [x for x in (y.strip(WHITE) for y in b.text(i).split(b"\n")) if x]


def _share(b: Block, at: np.ndarray, found: Callable[[bytes], bool], over: float) -> np.ndarray:
    """Documents in which more than ``over`` of ten full lines are found."""
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at):
        lines = _full_lines(b, i)
        out[k] = 10 * sum(map(found, lines)) > over * len(lines)
    return out


def _bullets(b, m, at):
    return _share(b, at, lambda x: x.startswith(BULLETS), 9)


def _ellipses(b, m, at):
    return _share(b, at, lambda x: x.endswith(ELLIPSES), 3)


def _most(b: Block, m: dict, at: np.ndarray, n: int) -> np.ndarray:
    """How often the most frequent run of ``n`` words occurs in each document."""
    start, end, first = m["words"]
    h, out = Hasher(b.data), np.zeros(len(at), np.int64)
    for k, i in enumerate(at):
        w = h(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])
        key = w[: len(w) - n + 1]
        for j in range(1, n):
            key = mix(key + w[j : len(w) - n + 1 + j])
        if len(key):
            key = np.sort(key)
            out[k] = np.diff(np.flatnonzero(np.append(np.concatenate([[True], key[1:] != key[:-1]]), True))).max()
    return out


def _one_word(b, m, at):
    return 10 * _most(b, m, at, 1) > 3 * m["n_words"][at]


def _one_pair(b, m, at):
    return 10 * _most(b, m, at, 2) > 2 * m["n_words"][at]


RULES = (
    Rule("symbols per word", _symbols),
    Rule("repeated lines", _lines),
    Rule("word length", _word_length),
    Rule("shouting", _shouting),
    Rule("digits", _digits),
    Rule("capitals", _capitals),
    Rule("lists", _bullets),
    Rule("cut lines", _ellipses),
    Rule("one word", _one_word),
    Rule("one pair of words", _one_pair),
)


def base_failed(m: dict) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def greedy_order(cost: list[float], masks: dict[int, int]) -> list[int]:
    """Rules by rejections of what is left per cost.  ``masks`` counts sampled documents by the set of rules that reject them."""
    left, order, masks = set(range(len(cost))), [], dict(masks)
    while left:
        rate = {i: (sum(n for m, n in masks.items() if m >> i & 1) + 0.01) / (cost[i] + 1e-6) for i in left}
        best = min(left, key=lambda i: (-rate[i], i))
        order.append(best)
        left.remove(best)
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
    return order


def cascade_order(spark: SparkSession, docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Order of the rules from a sample spread over all partitions; the count it needs comes from file footers where ``docs`` is a scan."""
    rules = list(rules)

    def measure(batches):
        cost, masks = np.zeros(len(rules)), {}
        for batch in batches:
            for b in blocks(batch.column(0)):
                m = measures(b)
                at = np.flatnonzero(~base_failed(m))
                mask = np.zeros(len(at), np.int64)
                for i, r in enumerate(rules):
                    t = time.perf_counter()
                    mask |= r.rejects(b, m, at).astype(np.int64) << i
                    cost[i] += time.perf_counter() - t
                for x, n in zip(*np.unique(mask, return_counts=True)):
                    masks[int(x)] = masks.get(int(x), 0) + int(n)
        rows = [(i, None, c, 0) for i, c in enumerate(cost.tolist())] + [(None, m, 0.0, n) for m, n in masks.items()]
        cols, kinds = list(zip(*rows)), [pa.int32(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["rule", "mask", "cost", "n"])

    share = min(1.0, sample_rows / max(docs.count(), 1))
    got = docs.select("text").sample(share, seed=1).mapInArrow(measure, "rule int, mask long, cost double, n long").groupBy("rule", "mask").agg(F.sum("cost"), F.sum("n")).collect()
    cost = {r[0]: r[2] for r in got if r[0] is not None}
    return greedy_order([cost.get(i, 0.0) for i in range(len(rules))], {r[1]: r[3] for r in got if r[0] is None})


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in OUT) + ", base_failed boolean, kept boolean"


def judge(b: Block, ordered) -> dict[str, np.ndarray]:
    m = measures(b)
    failed = base_failed(m)
    alive = np.flatnonzero(~failed)
    for r in ordered:
        if not len(alive):
            break
        alive = alive[~r.rejects(b, m, alive)]
    kept = np.zeros(b.n, bool)
    kept[alive] = True
    return {c: m[c].astype(np.int64) for c in OUT} | {"base_failed": failed, "kept": kept}


def quality_rules(docs: DataFrame, carry: list[str], rules=RULES, only_kept: bool = False) -> DataFrame:
    """Columns ``carry`` of ``docs`` with the measures and verdict; ``only_kept`` drops rejected rows and returns ``carry`` alone."""
    spark = docs.sparkSession
    small_batches(spark)
    ordered = [rules[i] for i in cascade_order(spark, docs, rules)]
    if only_kept:

        @F.arrow_udf("boolean")
        def keeps(text: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([judge(b, ordered)["kept"] for b in blocks(text)] or [np.zeros(0, bool)]))

        return docs.where(keeps("text")).select(*carry)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]

    def run(batches):
        for batch in batches:
            n = len(carry)
            for b in blocks(batch.column(n)):
                got = judge(b, ordered)
                part = batch.slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [pa.array(v) for v in got.values()], carry + list(got))

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, ", ".join(fields + [SCHEMA]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
ln AS (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
lc AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup FROM ln GROUP BY 1),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8))),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_rep FROM
        (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE c > 1) GROUP BY 1),
fl AS (SELECT doc_id, trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
fs AS (SELECT doc_id, count(*) AS n_full, count(*) FILTER (l[1] IN ('-', '*', '•')) AS n_bullets, count(*) FILTER (ends_with(l, '...') OR ends_with(l, '…')) AS n_cut FROM fl WHERE l <> '' GROUP BY 1),
mw AS (SELECT doc_id, max(c) AS most_word FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2) GROUP BY 1),
mp AS (SELECT doc_id, max(c) AS most_pair FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT w.doc_id, coalesce(n_full, 0) AS n_full, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_cut, 0) AS n_cut, coalesce(most_word, 0) AS most_word, coalesce(most_pair, 0) AS most_pair, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        length(regexp_replace(t, '[^!?]', '', 'g')) AS shout, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps
      FROM w LEFT JOIN lc ON w.doc_id = lc.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN fs ON w.doc_id = fs.doc_id LEFT JOIN mw ON w.doc_id = mw.doc_id LEFT JOIN mp ON w.doc_id = mp.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR 10 * shout > 3 * n_words OR 2 * digits > word_chars OR 2 * caps > word_chars
    OR 10 * n_bullets > 9 * n_full OR 10 * n_cut > 3 * n_full OR 10 * most_word > 3 * n_words OR 10 * most_pair > 2 * n_words) AS kept
FROM b
"""
