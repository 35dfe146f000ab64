"""Shortest line edits between two versions of a text, and chunks brought up to date around the edits alone.

A hunk (a, b, c, d) says that old lines a..b become new lines c..d, both from 0 and without the end.  Texts are lines without their breaks; a null version has no lines.

Defined cases: equal versions have no hunks; versions that differ in over ``MAX_EDITS`` lines are one hunk between their common head and tail (a script, though not the shortest);
very long texts are one row each.
"""

from __future__ import annotations

from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDITS = 3000
Hunk = tuple[int, int, int, int]


def lines(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


def script(old: list[str], new: list[str], most: int = MAX_EDITS) -> list[Hunk]:
    """The hunks of a shortest script: furthest-reaching paths by number of edits, between the common head and tail."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    if not a or not b:
        return [(head, head + len(a), head, head + len(b))] if a or b else []
    steps = _edits(a, b, most)
    if steps is None:
        return [(head, head + len(a), head, head + len(b))]
    out: list[Hunk] = []
    for x, y, dx, dy in steps:  # one line deleted (dx) or inserted (dy) at (x, y)
        x, y = x + head, y + head
        if out and out[-1][1] == x and out[-1][3] == y:
            out[-1] = (out[-1][0], x + dx, out[-1][2], y + dy)
        else:
            out.append((x, x + dx, y, y + dy))
    return out


def _edits(a: list[str], b: list[str], most: int) -> list[tuple[int, int, int, int]] | None:
    """Single-line steps (x, y, deleted, inserted) of a shortest script; none if it takes over ``most``."""
    limit = min(len(a) + len(b), most)
    far, zero, trace = array("i", bytes(4 * (2 * limit + 3))), limit + 1, []
    for d in range(limit + 1):
        trace.append(far[zero - d - 1 : zero + d + 2])  # the furthest x of each diagonal after d - 1 edits
        for k in range(-d, d + 1, 2):
            x = _from(trace[d], d, k)[0]
            y = x - k
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            far[zero + k] = x
            if x >= len(a) and y >= len(b):
                return _walk(trace, len(a), len(b))
    return None


def _from(far: array, d: int, k: int) -> tuple[int, bool]:
    """Where the d-th edit puts diagonal k, and whether it inserts."""
    left, right = far[k + d], far[k + d + 2]
    insert = k == -d or (k != d and left < right)
    return (right if insert else left + 1) if d else 0, insert


def _walk(trace: list[array], x: int, y: int) -> list[tuple[int, int, int, int]]:
    out = []
    for d in range(len(trace) - 1, 0, -1):
        k = x - y
        at, insert = _from(trace[d], d, k)
        x = at if insert else at - 1
        y = x - (k + 1 if insert else k - 1)
        out.append((x, y, 0, 1) if insert else (x, y, 1, 0))
    return out[::-1]


def applied(old: list[str], hunks: list[tuple[Hunk, list[str]]]) -> list[str]:
    """The new lines: each hunk comes with the lines that it puts in."""
    out, at = [], 0
    for (a, b, _, _), put in hunks:
        out += old[at:a] + put
        at = b
    return out + old[at:]


def chunk_end(text: list[str], start: int, limit: int) -> int:
    """End of the greedy chunk from ``start``: whole lines of at most ``limit`` characters, or one line.  It depends on its own lines and the next one alone."""
    size, i = 0, start
    while i < len(text) and (i == start or size + len(text[i]) + 1 <= limit):
        size += len(text[i]) + 1
        i += 1
    return i


def chunked(text: list[str], limit: int) -> list[int]:
    """Ends of all chunks."""
    ends: list[int] = []
    while (at := ends[-1] if ends else 0) < len(text):
        ends.append(chunk_end(text, at, limit))
    return ends


def rechunked(ends: list[int], hunks: list[Hunk], new: list[str], limit: int) -> list[tuple[int, int, bool]]:
    """(start, end, kept) of the chunks of ``new``.  A chunk of the old version that starts here and is, with the line after it, untouched is moved; the others are made."""
    out: list[tuple[int, int, bool]] = []
    at, passed, shift = 0, 0, 0
    next_end = dict(zip([0, *ends], ends))
    while at < len(new):
        while passed < len(hunks) and hunks[passed][3] <= at:
            shift = hunks[passed][3] - hunks[passed][1]
            passed += 1
        ahead = hunks[passed] if passed < len(hunks) else None
        end = next_end.get(at - shift) if ahead is None or at <= ahead[2] else None
        if end is not None and (ahead is None or end < ahead[0]):
            out.append((at, end + shift, True))
        else:
            out.append((at, chunk_end(new, at, limit), False))
        at = out[-1][1]
    return out


def edit_scripts(versions: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """(key, a, b, c, d, put) of each hunk between two versions of a text."""

    def run(frames):
        for pdf in frames:
            out = []
            for k, x, y in zip(pdf[key], pdf[old], pdf[new]):
                now = lines(y)
                out += [(k, *h, now[h[2] : h[3]]) for h in script(lines(x), now)]
            yield pd.DataFrame(out, columns=[key, "a", "b", "c", "d", "put"])

    return versions.select(key, old, new).mapInPandas(run, f"{key} {dict(versions.dtypes)[key]}, a int, b int, c int, d int, put array<string>")


def apply_scripts(texts: DataFrame, scripts: DataFrame, key: str, old: str = "old") -> DataFrame:
    """(key, new): the old texts with their scripts applied, in the JVM: the lines between hunks stay, those of hunks are put in.  Only for texts that are not null."""
    hunks = scripts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", "c", "b", "put"))).alias("__h"))
    d = texts.join(hunks, key, "left").withColumn("__l", F.split(old, "\n", -1)).withColumn("__h", F.coalesce("__h", F.array().cast(dict(hunks.dtypes)["__h"])))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    part = lambda x, y: F.slice("__l", x + 1, F.greatest(y - x, F.lit(0)))
    done = F.aggregate("__h", start, lambda s, h: F.struct(h["b"].alias("at"), F.concat(s["out"], part(s["at"], h["a"]), h["put"]).alias("out")))
    return d.withColumn("__s", done).select(key, F.array_join(F.concat("__s.out", part(F.col("__s.at"), F.size("__l"))), "\n").alias("new"))


def rechunk(versions: DataFrame, key: str, limit: int, old: str = "old", new: str = "new") -> DataFrame:
    """(key, start, end, kept, hash) of the chunks of the new version; the old version's chunks are kept where no edit is near."""
    import hashlib

    def run(frames):
        for pdf in frames:
            out = []
            for k, x, y in zip(pdf[key], pdf[old], pdf[new]):
                was, now = lines(x), lines(y)
                for s, e, kept in rechunked(chunked(was, limit), script(was, now), now, limit):
                    out.append((k, s, e, kept, hashlib.md5("\n".join(now[s:e]).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=[key, "start", "end", "kept", "hash"])

    return versions.select(key, old, new).mapInPandas(run, f"{key} {dict(versions.dtypes)[key]}, start int, end int, kept boolean, hash string")
