"""Running reducers over event streams; their batch twins are in operators.events and plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tool_summary(events: DataFrame) -> DataFrame:
    """Calls by tool; state grows with the number of tools only."""
    return events.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("total"))


def latest(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by time window; the watermark bounds the state and drops what comes later than it allows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
