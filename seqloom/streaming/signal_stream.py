"""The signal bins on a stream: the batch query's aggregate, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_bins(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A1 over (ts, event_type, value): hourly means of each track, final once the watermark has passed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("chrom")).agg(F.avg("value").alias("binned_score"), F.count("*").alias("n"))
    return g.select("chrom", F.unix_seconds("window.start").alias("genomic_start"), "binned_score", "n")


def replay(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
