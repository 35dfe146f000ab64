"""Windowed operational metrics: percentiles, rates, trends, alerts."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def elements(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and, for each name, the element of the sorted values at a place (from 1) that may depend on n; null values do not count.

    Equal values are counted before they meet, and a running sum over them finds the elements, so no group is held in memory.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    c = c.withColumn("_to", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    c = c.join(c.groupBy(*keys).agg(F.sum("_c").alias("n")), keys)
    at = lambda i: F.max(F.when((F.col("_to") >= i) & (F.col("_to") - F.col("_c") < i), F.col(value)))
    return c.groupBy(*keys, "n").agg(*[at(place(F.col("n"))).alias(name) for name, place in places.items()])


def floor_index_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``sorted[int(n * p)]`` for each named share: an element, never interpolated."""
    return elements(df, keys, value, {name: (lambda n, p=p: F.floor(n * p) + 1) for name, p in shares.items()})


def exclusive_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Position p * (n + 1) with linear interpolation; null for fewer than two values."""
    place = lambda n: F.greatest(F.lit(1), F.least(F.floor(F.lit(p) * (n + 1)), n - 1))
    e = elements(df, keys, value, {"_a": place, "_b": lambda n: place(n) + 1})
    n = F.col("n")
    return e.select(*keys, F.when(n >= 2, F.col("_a") + (F.lit(p) * (n + 1) - place(n)) * (F.col("_b") - F.col("_a"))).alias(name))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def micros(c) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def islands(df: DataFrame, keys: list[str], order: str, firing: Column) -> DataFrame:
    """Runs of consecutive rows that fire: keys, run number, first and last ``order``, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_f", F.coalesce(firing, F.lit(False))).withColumn("_new", F.when(F.col("_f") & ~F.lag("_f", 1, False).over(w), 1).otherwise(0))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("_f").groupBy(*keys, "run").agg(F.min(order).alias("started"), F.max(order).alias("ended"), F.count("*").alias("n"))


def bands(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first label whose floor the value reaches."""
    out = None
    for floor, label in steps:
        out = F.when(value >= floor, label) if out is None else out.when(value >= floor, label)
    return out.otherwise(last)


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Batch form of session windows: rows with their session number; a gap of ``gap_seconds`` starts a new one."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    gap = micros(ts) - micros(F.lag(ts).over(w))
    d = df.withColumn("_new", F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0))
    return d.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
