"""Python source read as a syntax tree by the standard parser: the truth that layout is compared with."""

from __future__ import annotations

import ast
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOL = "kind string, name string, qualified string, start_line int, end_line int, params string, doc string"
#: Statements that add one each to the complexity of a tree.
STEPS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try)


def parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def parameters(a: ast.arguments) -> str:
    names = [x.arg for x in a.posonlyargs + a.args]
    if a.vararg:
        names.append("*" + a.vararg.arg)
    names += [x.arg for x in a.kwonlyargs]
    if a.kwarg:
        names.append("**" + a.kwarg.arg)
    return ", ".join(names)


def symbols(source: str | None) -> Iterator[tuple]:
    """Classes, methods and functions, nested ones too, with their qualified names; nothing if the source does not parse."""
    stack = [(n, "", False) for n in reversed(tree.body)] if (tree := parsed(source)) else []
    while stack:
        node, prefix, within = stack.pop()
        inner, in_class = prefix, within
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            a_class = isinstance(node, ast.ClassDef)
            inner, in_class = prefix + node.name + ".", a_class
            kind = "class" if a_class else "method" if within else "function"
            yield kind, node.name, prefix + node.name, node.lineno, node.end_lineno, "" if a_class else parameters(node.args), ast.get_docstring(node) or ""
        stack += [(n, inner, in_class) for n in reversed(list(ast.iter_child_nodes(node)))]


def tree_complexity(source: str | None) -> int | None:
    """One and one more for each branching or looping statement; null if the source does not parse."""
    tree = parsed(source)
    return None if tree is None else 1 + sum(isinstance(n, STEPS) for n in ast.walk(tree))


def symbol_table(files: DataFrame, key: str, source: str) -> DataFrame:
    """One row a symbol of ``files(key, source)``."""
    names = [key, *(c.split()[0] for c in SYMBOL.split(", "))]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *s) for k, text in zip(pdf[key], pdf[source]) for s in symbols(text)], columns=names)

    return files.select(key, source).mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, {SYMBOL}")
