"""Structured Streaming variants of three batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plantlens.functions import domain


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly_mean(readings: DataFrame, *, unit: str, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Mean per unit and hour; a closed hour is emitted once the watermark has passed it."""
    return (
        readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour"), unit).agg(F.avg(value).alias(value), F.count("*").alias("n"))
        .select(unit, F.col("window.start").cast("timestamp_ntz").alias("hour"), value, "n")
    )


def exceedance_alerts(readings: DataFrame, limits: DataFrame, *, unit: str, ts: str, value: str) -> DataFrame:
    """Readings over their unit's limit with a severity label. ``limits`` (unit, limit) is a small parameter table."""
    hit = readings.join(limits, unit).filter(F.col(value) > F.col("limit"))
    return hit.select(unit, ts, value, "limit", domain.severity_label(domain.top_line(F.col(value), F.col("limit"))).alias("severity"))


def error_counts(log: DataFrame, *, ts: str, error_type: str, size: str = "15 minutes", slide: str = "5 minutes",
                 late: str = "10 minutes") -> DataFrame:
    """Errors per type in sliding windows."""
    return (
        log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
        .groupBy(F.window(ts, size, slide), error_type).agg(F.count("*").alias("n"))
        .select(error_type, F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), "n")
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there into Parquet and stop; restarts continue from the checkpoint."""
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query
