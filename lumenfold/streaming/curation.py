"""Streaming curation: replicate summaries over event-time windows, and stateless feature application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.curation import potency

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_potency(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and event type: mean potency, measurements, spread. Rows later than the watermark are dropped."""
    p = events.withColumn("_p", potency(F.col("value"))).filter("_p is not null").withWatermark("ts", late)
    g = p.groupBy(F.window("ts", window), "event_type").agg(F.avg("_p").alias("p_mean"), F.count(F.lit(1)).alias("n"), (F.max("_p") - F.min("_p")).alias("spread"))
    return g.select(F.col("window.start").alias("start"), "event_type", "p_mean", "n", "spread")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; started again with the same checkpoint it goes on from there."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
