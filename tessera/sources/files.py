"""File, rule, configuration, history and queue sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rules import parse_rules

#: Suffixes of files taken in, folders left out, and the default weights of canon levels.
SUFFIXES = (
    "py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "cpp", "c", "h", "hpp", "cs", "rb", "php", "dart", "swift", "kt", "m", "vue", "svelte", "astro", "scala", "r", "jl", "perl", "lua",
    "md", "yaml", "yml", "json", "toml", "txt", "sql", "xml", "ini", "env", "graphql", "prisma", "rst", "adoc",
)
IGNORED = ("node_modules", ".git", "__pycache__", "build", "dist", "target", ".venv")
CANON_WEIGHTS = {"primary": 1.0, "secondary": 0.7, "reference": 0.4, "deprecated": 0.1, "experimental": 0.3}
MAX_BYTES = 10 * 1024 * 1024


def file_scan(spark: SparkSession, root: str, suffixes=SUFFIXES, ignored=IGNORED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, suffix, size, modified, content) of admitted files, each once.  Size and name are tested before contents are kept."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parts = F.split(F.regexp_replace("path", "^" + root.replace(".", r"\.").rstrip("/") + "/?", ""), "/")
    keep = suffix.isin(*suffixes) & (F.col("length") <= max_bytes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored)))
    return raw.where(keep).select("path", suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content")).dropDuplicates(["path"])


def projects(files: DataFrame, root: str) -> DataFrame:
    """Distinct first folders below ``root``."""
    rest = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.where(rest.contains("/")).select(F.substring_index(rest, "/", 1).alias("project")).distinct()


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """Exclusion rules of a text file; a rule file is small by its limit."""
    from tessera.operators.rules import RULE_SCHEMA

    lines = [r[0] for r in spark.read.text(path, wholetext=False).collect()]
    return F.broadcast(spark.createDataFrame(parse_rules(lines), RULE_SCHEMA))


def canon_config(text: str) -> list[tuple[str, str, float]]:
    """(pattern, level, weight) in order, from YAML if a parser is installed, else from JSON."""
    try:
        import yaml
    except ImportError:
        data = json.loads(text)
    else:
        data = yaml.safe_load(text)
    out = []
    for level, default in CANON_WEIGHTS.items():
        for entry in (data or {}).get(level, []):
            one = entry if isinstance(entry, dict) else {"pattern": entry}
            out.append((one["pattern"], level, float(one.get("weight", default))))
    return out


def git_metrics(log: DataFrame, as_of) -> DataFrame:
    """Per file of ``log(path, sha, email, ts)``: last change, commits of 30 days, authors, last commit."""
    return log.groupBy("path").agg(
        F.max("ts").alias("last_modified"), F.count_if(F.col("ts") >= as_of - F.expr("INTERVAL 30 DAYS")).alias("change_frequency"),
        F.count_distinct("email").alias("author_count"), F.substring(F.max_by("sha", "ts"), 1, 8).alias("last_commit"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """A log written with one ``sha|email|unix time|path`` a line."""
    p = F.split("value", r"\|", 4)
    return spark.read.text(path).select(p[3].alias("path"), p[0].alias("sha"), p[1].alias("email"), F.timestamp_seconds(p[2].cast("long")).alias("ts"))


def enqueue(jobs: DataFrame, folder: str) -> None:
    """Put rows on a queue: one JSON message a line, in new files of a folder; a file is there whole or not at all."""
    jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value")).write.mode("append").text(folder)


def queue(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream of JSON messages, one a line, from files that land in a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("value").alias("raw"), F.from_json("value", schema).alias("m")).select("raw", "m.*")
