"""Operator 4: URL allow and block rules in a trie over reversed host labels and path segments.

The trie is broadcast while the rules are at most ``MAX_BROADCAST_RULES``; a longer list goes through an equi-join on
every (host suffix, path prefix) of a page, with the same result.  The deepest host wins, then the longest path, then
``allow`` before ``block`` for one rule given both ways.  A page that no rule fits gets ``DEFAULT_VERDICT``.

Defined cases: a null url or one without ``://`` has an empty host and path, fits only rules for the empty host and else
gets the default; repeated rows are judged alike; a very long url is judged whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 1_000_000
DEFAULT_VERDICT = "allow"
#: The rules of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


class Trie:
    """Nodes by host label from the right; each host node holds a trie of path segments.  A rule's last, open segment is kept as a text prefix."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in sorted(rules, reverse=True):
            node = self.root
            for label in reversed(host.split(".")) if host else [""]:
                node = node.setdefault("kids", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, rest = path.split("/")
            for seg in whole:
                node = node.setdefault("kids", {}).setdefault(seg, {})
            node.setdefault("ends", {})[rest] = (host + path, verdict)

    @classmethod
    def over(cls, root: dict) -> "Trie":
        """A trie around broadcast nodes."""
        out = cls(())
        out.root = root
        return out

    @staticmethod
    def _path(node: dict, segments: list[str]):
        """The longest rule of one host node that the path starts with."""
        best = None
        for seg in segments:
            fits = [e for e in node.get("ends", ()) if seg.startswith(e)]
            if fits:
                best = node["ends"][max(fits, key=len)]
            node = node.get("kids", {}).get(seg)
            if node is None:
                break
        return best

    def find(self, host: str, path: str):
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("kids", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._path(node["paths"], segments) or best
        return best


def split_url(url: str = "url") -> tuple[F.Column, F.Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def url_filter(pages: DataFrame, rules, default: str = DEFAULT_VERDICT, max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule and verdict."""
    spark = pages.sparkSession
    host, path = split_url()
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = list(rules)
    if len(rules) <= max_broadcast:
        trie = spark.sparkContext.broadcast(Trie(rules).root)

        @F.pandas_udf("rule string, verdict string")
        def match(h: pd.Series, p: pd.Series) -> pd.DataFrame:
            find = Trie.over(trie.value).find
            got = [find(a, b) or (None, default) for a, b in zip(h, p)]
            return pd.DataFrame(got, columns=["rule", "verdict"])

        return parsed.withColumn("m", match("host", "path")).select("page_id", "host", "path", "m.rule", "m.verdict")
    table = spark.createDataFrame([(h, p, v) for v, h, p in rules], "rhost string, rpath string, v string").groupBy("rhost", "rpath").agg(F.min("v").alias("v"))
    lengths = [r[0] for r in table.select(F.length("rpath")).distinct().collect()]
    pairs = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    keys = pairs.withColumn("rhost", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    keys = keys.withColumn("rpath", F.explode(F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))))
    found = keys.join(table, ["rhost", "rpath"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), F.col("v").alias("verdict")), F.struct(F.length("rhost"), F.length("rpath"))).alias("m"))
    return parsed.join(found, ["host", "path"], "left").select("page_id", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
p AS (SELECT page_id, coalesce(lower(regexp_extract(r, '^([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT p.page_id, max_by(h || q, length(h) * 100000 + length(q)) AS rule, max_by(verdict, length(h) * 100000 + length(q)) AS verdict
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
