"""Scans of parquet tables, structurally scoped to a project or tenant where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scoped(df: DataFrame, **keys) -> DataFrame:
    """Rows of one tenant, project or label; every scan of shared tables goes through here."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df
