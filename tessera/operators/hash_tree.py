"""A hash tree of directories, folded bottom-up a level at a time, and a comparison that descends only where hashes differ.

A directory has a hash of its own six fields (as JSON with sorted keys) and a tree hash of that and its children.  Children are folded as sums of parts of their tree hashes, which
is the same in any order, so a directory of any number of children is summed before it is shuffled.  Trees are stored by depth, so a level reads its own folder.

Defined cases: files without a path are left out; directories above a file exist, with no files of their own; an empty table gives an empty tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import stored

FIELDS = "file_count long, languages array<string>, last_modified long, size_bytes long, total_lines long"


def parent(path) -> F.Column:
    """The directory above; the root is the empty path, and nothing is above it."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p == "", None).when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def directories(files: DataFrame) -> DataFrame:
    """(dir, depth, own): every directory above ``files(path, lines, size, language, modified)`` with the hash of its own fields over its direct files."""
    f = files.where("path is not null").withColumn("dir", parent("path"))
    direct = f.groupBy("dir").agg(F.count("*").alias("file_count"), F.array_sort(F.collect_set("language")).alias("languages"), F.max("modified").alias("last_modified"), F.sum("size").alias("size_bytes"), F.sum("lines").alias("total_lines"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    every = f.select("dir").distinct().select(F.explode(above).alias("dir")).distinct()
    d = every.join(direct, "dir", "left")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    listed = F.array_join(F.transform(F.coalesce("languages", F.array().cast("array<string>")), quoted), ", ")
    own = F.concat(F.lit('{"file_count": '), number("file_count"), F.lit(', "languages": ['), listed, F.lit('], "last_modified": '), number("last_modified"), F.lit(', "path": '), quoted(F.col("dir")), F.lit(', "size_bytes": '), number("size_bytes"), F.lit(', "total_lines": '), number("total_lines"), F.lit("}"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    return d.select("dir", depth.alias("depth"), F.sha2(own, 256).alias("own"))


def _parts(h: str) -> list[F.Column]:
    return [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def tree(files: DataFrame) -> DataFrame:
    """(dir, up, depth, own, hash) of every directory, stored by depth."""
    d = stored(directories(files), "directories")
    deepest = d.agg(F.max("depth")).first()[0]
    below, out = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = d.where(F.col("depth") == level).withColumn("up", parent("dir"))
        zero = F.lit(0).cast("decimal(38,0)")
        if below is None:
            rows = rows.withColumns({f"s{i}": zero for i in range(4)}).withColumn("kids", F.lit(0).cast("long"))
        else:
            kids = below.groupBy(F.col("up").alias("dir")).agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(_parts("hash"))], F.count("*").alias("kids"))
            rows = rows.join(kids, "dir", "left").withColumns({f"s{i}": F.coalesce(f"s{i}", zero) for i in range(4)}).withColumn("kids", F.coalesce("kids", F.lit(0)))
        rows = rows.withColumn("hash", F.sha2(F.concat_ws("|", "own", "kids", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256))
        below = stored(rows.select("dir", "up", "depth", "own", "hash"), f"level-{level}")
        out = below if out is None else out.unionByName(below)
    return d.sparkSession.createDataFrame([], "dir string, up string, depth int, own string, hash string") if out is None else stored(out, "tree", "depth")


def differing(old: DataFrame, new: DataFrame, under: str = "", met: list[int] | None = None) -> DataFrame:
    """(dir, change) of directories at or below ``under`` that were added, deleted, or whose own fields differ.

    A level compares the children of directories whose tree hashes differ and of those that are on one side only; ``met`` gets the number of directories compared on each level.
    """
    spark: SparkSession = old.sparkSession
    depth = 0 if under == "" else under.count("/") + 1
    side = lambda t, n: t.select("dir", "up", "depth", F.col("own").alias(f"own_{n}"), F.col("hash").alias(f"hash_{n}"))
    a, b, out, open_ = side(old, "a"), side(new, "b"), None, None
    while True:
        x, y = (t.where(F.col("depth") == depth) for t in (a, b))
        if open_ is None:
            x, y = x.where(F.col("dir") == under), y.where(F.col("dir") == under)
        else:
            x, y = (t.join(open_, t["up"] == open_["__dir"], "left_semi") for t in (x, y))
        pairs = stored(x.drop("up", "depth").join(y.drop("up", "depth"), "dir", "full"), "pairs")
        n = pairs.count()
        if met is not None:
            met.append(n)
        change = F.when(F.col("own_a").isNull(), "added").when(F.col("own_b").isNull(), "deleted").when(F.col("own_a") != F.col("own_b"), "modified")
        found = pairs.select("dir", change.alias("change")).where("change is not null")
        out = found if out is None else out.unionByName(found)
        open_ = pairs.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(F.col("dir").alias("__dir"))
        if not n or open_.isEmpty():
            return out if out is not None else spark.createDataFrame([], "dir string, change string")
        depth += 1
