"""Exclusion and penalty rules: pattern joins of paths with a small rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex

RULE_SCHEMA = "action string, regex string, weight double, line int"
MAX_RULES = 10_000


def parse_rules(lines: list[str]) -> list[tuple]:
    """One rule a line: ``!deprioritize:glob,weight``, ``regex:pattern`` (from the start), else a glob to exclude; # starts a comment."""
    out = []
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("!deprioritize:"):
            pattern, _, weight = line[len("!deprioritize:") :].rpartition(",")
            out.append(("deprioritize", glob_regex(pattern.strip()), float(weight), i))
        elif line.startswith("regex:"):
            out.append(("exclude", "^(?:" + line[len("regex:") :] + ")", 1.0, i))
        else:
            out.append(("exclude", glob_regex(line), 1.0, i))
    if len(out) > MAX_RULES:
        raise ValueError(f"{len(out)} rules; the rule table is broadcast and holds at most {MAX_RULES}")
    return out


def rule_table(spark: SparkSession, lines: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(parse_rules(lines), RULE_SCHEMA))


def not_excluded(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Anti join: files that no exclude rule fits."""
    return files.join(rules.where("action = 'exclude'"), F.rlike(F.col(path), F.col("regex")), "left_anti")


def penalties(files: DataFrame, rules: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Files with the largest weight of the deprioritize rules that fit, 0 if none."""
    d = rules.where("action = 'deprioritize'").select("regex", "weight")
    fits = files.select(key, path).join(d, F.rlike(F.col(path), F.col("regex"))).groupBy(key).agg(F.max("weight").alias("penalty"))
    return files.join(fits, key, "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))


def parsed(lines: DataFrame) -> DataFrame:
    """(line, project, action, kind, pattern, weight) of ``lines(line, project, text)``: comments and blanks go; a penalty without a weight is a half."""
    text = F.trim("text")
    soft, rest = text.startswith("!deprioritize:"), F.regexp_replace(text, "^(!deprioritize:|regex:)", "")
    given = F.try_element_at(F.split(rest, ","), F.lit(2)).cast("double")
    return lines.where((text != "") & ~text.startswith("#")).select(
        "line", "project", F.when(soft, "deprioritize").otherwise("exclude").alias("action"), F.when(text.startswith("regex:"), "regex").otherwise("glob").alias("kind"),
        F.substring_index(rest, ",", 1).alias("pattern"), F.when(soft, F.coalesce(given, F.lit(0.5))).otherwise(1.0).alias("weight"))
