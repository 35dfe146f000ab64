"""All registered queries of the retrieval and graph engine, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold ``Q``, a dict name -> (function, SQL or None).
MODULES: tuple[str, ...] = ("code", "corpus", "edges", "events", "graph", "indexes", "jobs", "retrieval", "search", "streams")


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"tessera.plans.{m}").Q)
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.retrieval import unified

    return unified(spark, sf_dir)
