"""Keeping two stores the same: comparison, drift, repair, keyed writes.

A dual write goes to the graph first, then to the vectors; graph rows whose vector was not written are taken back.  The other operators check and repair stores written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import stored


def compare(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): synced, mismatch, missing_in_a or missing_in_b."""
    x, y = a.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_ia")), b.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_ib"))
    j = x.join(y, key, "full")
    state = F.when(F.col("_ia").isNull(), "missing_in_a").when(F.col("_ib").isNull(), "missing_in_b").when(F.col("_a").eqNullSafe(F.col("_b")), "synced").otherwise("mismatch")
    return j.select(key, state.alias("state"))


def drift(states: DataFrame) -> DataFrame:
    """One row: counts by state, drift rate, verdict."""
    n, bad = F.count("*"), F.count_if(F.col("state") != "synced")
    rate = F.coalesce(F.try_divide(bad.cast("double"), n.cast("double")), F.lit(0.0))
    verdict = F.when(rate == 0, "consistent").when(rate <= 0.05, "minor").when(rate <= 0.1, "moderate").otherwise("severe")
    return states.agg(n.alias("sampled"), *[F.count_if(F.col("state") == s).alias(s) for s in ("missing_in_a", "missing_in_b", "mismatch")], F.round(rate, 6).alias("rate"), verdict.alias("verdict"))


def repair_plan(states: DataFrame, key: str) -> DataFrame:
    action = F.when(F.col("state") == "missing_in_b", "copy_to_b").when(F.col("state") == "missing_in_a", "delete_orphan").when(F.col("state") == "mismatch", "copy_from_a")
    return states.where("state <> 'synced'").select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key is not in it."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def delete(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_anti")


def sample_size(n: int, share: float = 0.01, least: int = 10, most: int = 1000) -> int:
    """A share of n rows, within bounds."""
    return max(least, min(int(share * n), most))


def stable_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of their key: uniform and the same on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def dual_write(rows: DataFrame, key: str, graph_ok, vector_ok, graph: list[str], vectors: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph store, the vector store and the event log (key, step, status) after a batch of ``rows``.

    Rows that the graph refuses stop there.  What the second store has taken is read back from it; graph rows that are not in it are rolled back.  Each step is written before the next begins, so a
    batch that comes again after a failure gives the same stores.
    """
    first = stored(rows.where(graph_ok).select(key, *graph), "graph-try")
    second = stored(rows.where(vector_ok).join(first.select(key), key, "left_semi").select(key, *vectors), "vectors")
    kept = stored(first.join(second.select(key), key, "left_semi"), "graph")
    event = lambda df, step, status: df.select(key, F.lit(step).alias("step"), F.lit(status).alias("status"))
    refused = rows.select(key).join(first.select(key), key, "left_anti")
    undone = first.select(key).join(kept.select(key), key, "left_anti")
    log = [event(refused, 1, "graph_failed"), event(first, 1, "graph_written"), event(second, 2, "written"), event(undone, 2, "vector_failed"), event(undone, 3, "rolled_back")]
    out = log[0]
    for x in log[1:]:
        out = out.unionByName(x)
    return kept, second, stored(out, "events")
