"""Structured Streaming over event files: sources, windows, and runs that end when the input does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-streams/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 10) -> DataFrame:
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", per_trigger).parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run to the end of the input into a parquet folder, and read it; a run with the ``at`` of an earlier one goes on from its checkpoint."""
    spark, at = stream.sparkSession, at or scratch(stream.sparkSession)
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", f"{at}/out")
    else:
        w = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    w.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def saved_state(spark: SparkSession, at: str, operator: int, variable: str) -> DataFrame:
    """What the checkpoint of a run at ``at`` holds of one variable of a keyed processor: (key, value) structs, one row a key."""
    return spark.read.format("statestore").option("path", f"{at}/checkpoint").option("operatorId", operator).option("stateVarName", variable).load().select("key", "value")


def debounce(events: DataFrame, keys: list[str], gap: str, late: str = "1 day", sticky: str = "error") -> DataFrame:
    """One row for each quiet period: its last event type, and ``sticky`` if it occurred at all."""
    last = F.when(F.bool_or(F.col("event_type") == sticky), sticky).otherwise(F.max_by("event_type", F.struct("ts", "event_id")))
    g = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return g.agg(F.min("ts").alias("started"), F.count("*").alias("n"), last.alias("outcome")).drop("w")


def sampled(events: DataFrame, every: str, late: str = "1 day") -> DataFrame:
    """Tumbling counts and means by event type."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("started"), "event_type", "n", "mean")


def once(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
