"""Chunkers.  Fixed-size ones are plain SQL; those that carry state along a text run in Arrow batches."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections import deque
from itertools import accumulate
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "start_line int, end_line int, kind string, name string, content string"
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
#: What the parser raises on text that is no source, or is nested too deeply for its stack.
NO_SOURCE = (SyntaxError, ValueError, MemoryError, RecursionError)
BOUNDARY = re.compile(r"^\s*(def |class |async def |function |export |public |private |func |fn |impl |struct )")
MAX_TOKENS, LINES_AGAIN, SENTENCES_AGAIN = 512, 5, 2
IMPORT = re.compile(r"^\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\s+(.+)|.*require\(['\"]([^'\"]+)['\"]\))", re.M)


def estimate(text: str) -> int:
    return len(text) // 4


def line_chunks(docs: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Chunks of ``size`` lines with their md5; blank ones are left out."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    g = lines.groupBy(key, F.floor(F.col("pos") / size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.array_join(F.col("l.line"), "\n")
    return g.select(key, "chunk", (F.col("chunk") * size + 1).alias("start_line"), F.size("l").cast("long").alias("n_lines"), F.md5(text).alias("hash"), F.length(text).cast("long").alias("n_chars"), (F.trim(text) == "").alias("blank")).where("not blank").drop("blank")


def ranges(costs: list[int], limit: int, overlap: Callable[[int], int], ends: Sequence[int] = ()) -> Iterator[tuple[int, int]]:
    """Greedy index ranges whose costs add up to at most ``limit``; each has at least one item that the range before has not.

    A range ends early at the first place of ``ends`` where it costs over half the limit.  The next one starts ``overlap(length)`` items before its end.
    """
    total = [0, *accumulate(costs)]
    start = stop = 0
    while stop < len(costs):
        least = stop + 1
        full = max(least, bisect_right(total, total[start] + limit) - 1)
        half = bisect_right(total, total[start] + limit // 2)
        at = bisect_left(ends, max(least, half))
        stop = min(full, ends[at]) if at < len(ends) else full
        yield start, stop
        start = stop - overlap(stop - start)


def code_chunks(text: str, limit: int = MAX_TOKENS) -> Iterator[tuple]:
    """Lines up to ``limit`` tokens, ending at a definition once half full; up to ``LINES_AGAIN`` lines overlap, a quarter at most."""
    lines = text.split("\n")
    costs = [max(1, estimate(x + "\n")) for x in lines]
    starts = [i for i, x in enumerate(lines) if BOUNDARY.match(x)]
    for a, b in ranges(costs, limit, lambda n: min(LINES_AGAIN, n // 4), starts):
        yield a + 1, b, "code", "", "\n".join(lines[a:b])


def sentence_chunks(text: str, limit: int = MAX_TOKENS) -> Iterator[tuple]:
    """Sentences up to ``limit`` tokens; up to ``SENTENCES_AGAIN`` of them overlap, half at most; line numbers are estimated from the chunks' own breaks."""
    sentences = SENTENCE.split(text)
    line = 1
    for a, b in ranges([estimate(x) for x in sentences], limit, lambda n: min(SENTENCES_AGAIN, n // 2)):
        chunk = " ".join(sentences[a:b])
        last = line + chunk.count("\n")
        yield line, last, "text", "", chunk
        line = last


def statements(tree: ast.AST) -> Iterator[ast.AST]:
    """Statements and their blocks in the order of ``ast.walk``, which enters every expression too; a definition never lies in one."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        for field in ("body", "handlers", "orelse", "finalbody", "cases"):
            if isinstance(found := getattr(node, field, None), list):
                todo.extend(found)
        yield node


def python_chunks(text: str) -> Iterator[tuple]:
    """Every definition of Python source, nested ones too; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except NO_SOURCE:
        return
    lines = text.split("\n")
    for node in statements(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield node.lineno, node.end_lineno, kind, node.name, "\n".join(lines[node.lineno - 1 : node.end_lineno])


def indent_chunks(text: str) -> Iterator[tuple]:
    """Definitions found by pattern; a block ends where the indentation returns."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = BOUNDARY.match(line)
        if m:
            depth, j = len(line) - len(line.lstrip()), i + 1
            while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > depth or lines[j].strip().startswith("}")):
                j += 1
            name = re.split(r"[\s(:{<]", line.strip()[len(m[1]) :].strip())[0]
            yield i + 1, j, "class" if "class" in m[1] or "struct" in m[1] else "function", name, "\n".join(lines[i:j])


def merge_small(chunks: list[tuple], least: int = 100) -> list[tuple]:
    """Join neighbours of one kind while the first is below ``least`` characters."""
    out: list[tuple] = []
    for c in chunks:
        if out and out[-1][2] == c[2] and len(out[-1][4]) < least:
            p = out.pop()
            c = (p[0], c[1], c[2], p[3] or c[3], p[4] + "\n" + c[4])
        out.append(c)
    return out


def split_large(chunks: list[tuple], most: int = 4 * MAX_TOKENS) -> list[tuple]:
    out = []
    for c in chunks:
        if len(c[4]) <= most:
            out.append(c)
        else:
            out += [(c[0] + p[0] - 1, c[0] + p[1] - 1, c[2], c[3], p[4]) for p in code_chunks(c[4])]
    return out


def dispatch(text: str, suffix: str) -> list[tuple]:
    """One chunk if small; definitions for code; sentences else.  Chunks under 100 characters go, unless the file is one chunk."""
    if estimate(text) <= MAX_TOKENS:
        return [(1, text.count("\n") + 1, "whole", "", text)]
    if suffix == "py":
        got = list(python_chunks(text)) or list(code_chunks(text))
    elif suffix in ("js", "ts", "go", "rs", "java"):
        got = list(indent_chunks(text)) or list(code_chunks(text))
    else:
        got = list(sentence_chunks(text))
    got = split_large(merge_small(got))
    return got if len(got) == 1 else [c for c in got if len(c[4].strip()) >= 100]


def chunked(docs: DataFrame, key: str, suffix: str) -> DataFrame:
    """Chunks of every document, by its suffix."""

    def run(batches):
        for pdf in batches:
            rows = [(k, *c) for k, t, s in zip(pdf[key], pdf["text"], pdf[suffix]) if t is not None for c in dispatch(t, s)]
            yield pd.DataFrame(rows, columns=[key, "start_line", "end_line", "kind", "name", "content"])

    return docs.select(key, "text", suffix).mapInPandas(run, f"{key} long, {CHUNK}")


def structure(source: str) -> dict:
    """Imports, functions, classes and calls of source text, by pattern."""
    imports = [a or b or d for a, b, _, d in IMPORT.findall(source)]
    functions = re.findall(r"^\s*(?:async\s+)?(?:def|function|func|fn)\s+(\w+)", source, re.M)
    classes = re.findall(r"^\s*(?:class|struct|interface)\s+(\w+)", source, re.M)
    calls = [c for c in re.findall(r"(\w+)\(", source) if c not in functions and c not in ("if", "for", "while", "return", "def", "class")]
    return {"imports": imports[:20], "functions": functions, "classes": classes, "calls": sorted(set(calls))}


def ast_complexity(source: str) -> int | None:
    """One a branch and definition, one a further boolean operand, two a level of nesting; null if it does not parse."""
    try:
        tree = ast.parse(source)
    except NO_SOURCE:
        return None
    branch = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.FunctionDef, ast.AsyncFunctionDef)
    n = sum(isinstance(x, branch) for x in ast.walk(tree)) + sum(len(x.values) - 1 for x in ast.walk(tree) if isinstance(x, ast.BoolOp))
    blocks = (ast.If, ast.While, ast.For, ast.With, ast.Try)

    def depth(node, d=0):
        return max([d, *(depth(c, d + isinstance(c, blocks)) for c in ast.iter_child_nodes(node) if isinstance(c, (*blocks, ast.FunctionDef, ast.ClassDef)))])

    return n + 2 * depth(tree)


def common_prefix_lines(old: str, new: str) -> int:
    """Lines two versions share from the start: where an incremental parse begins."""
    a, b = old.split("\n"), new.split("\n")
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n
