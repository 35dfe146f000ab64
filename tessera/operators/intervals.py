"""Interval joins by bins, and as-of joins by one sort.

Both cut a key along its line or time axis, so a key of any size is many tasks, and cost what comes out (and the bins an interval touches), not the product of a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bin(x, width: int) -> Column:
    return F.floor(F.col(x) / width).cast("long")


def _touched(start: str, end: str, width: int) -> Column:
    """All bins of an interval; none if it is empty or has a null end."""
    return F.when(F.col(start) <= F.col(end), F.sequence(_bin(start, width), _bin(end, width)))


def holding(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with each interval of its keys that holds it, both ends included.  Column names of the two sides differ but for the keys.

    A point lies in one bin, so no pair is met twice.  ``width`` should be near the usual length of an interval.  Null keys and points meet nothing.
    """
    p = points.withColumn("__bin", _bin(point, width))
    i = intervals.withColumn("__bin", F.explode(_touched(start, end, width)))
    return p.join(i, [*keys, "__bin"]).where(F.col(point).between(F.col(start), F.col(end))).drop("__bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Each pair of intervals of equal keys that share a point, once: in the bin where the later one starts."""
    x, y = left.withColumn("__bin", F.explode(_touched(*a, width))), right.withColumn("__bin", F.explode(_touched(*b, width)))
    met = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    first = F.col("__bin") == F.floor(F.greatest(a[0], b[0]) / width).cast("long")
    return x.join(y, [*keys, "__bin"]).where(met & first).drop("__bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, carry: list[str], span: int) -> DataFrame:
    """``left`` with ``carry`` of the latest row of ``right`` whose ``when`` is at or before ``at`` (numbers of one unit); null if there is none.

    Both sides go through one sort within (keys, range of ``span``), the last row seen carried along; what each range starts with comes from one row a range.  So a hot key is many tasks.
    Among right rows of one time the largest ``carry`` counts; right rows with a null time are never met, and a null ``at`` or key finds nothing.
    """
    value = F.struct(F.col(when).alias("__w"), *carry)
    r = right.where(F.col(when).isNotNull()).select(*keys, F.col(when).alias("__t"), F.lit(0).alias("__side"), value.alias("__v"), F.lit(None).cast(_struct(left)).alias("__l"))
    rows = F.struct(*[F.col(c) for c in left.columns])
    u = r.unionByName(left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), rows.alias("__l")))
    u = u.withColumn("__range", F.floor(F.col("__t") / span).cast("long"))
    within = Window.partitionBy(*keys, "__range").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    # one row a key and range
    last = u.where("__side = 0").groupBy(*keys, "__range").agg(F.max("__v").alias("__last"))
    ranges = u.select(*keys, "__range").distinct().join(last, [*keys, "__range"], "left")
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("__v", F.last("__v", ignorenulls=True).over(within)).where("__side = 1")
    got = u.join(ranges.select(*keys, "__range", before.alias("__before")), [*keys, "__range"], "left")
    v = F.coalesce("__v", "__before")
    return got.select("__l.*", *[F.when(F.col("__t").isNotNull(), v[c]).alias(c) for c in [*carry]])


def _struct(df: DataFrame) -> str:
    return f"struct<{', '.join(f'`{n}`: {t}' for n, t in df.dtypes)}>"
