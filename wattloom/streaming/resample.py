"""The resample as a stream: bins are emitted once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_stream(bronze: DataFrame, step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(series_id, timestamp, avg_load, n). Timestamps without zone are taken as the session's, as watermarks need one."""
    ts = bronze.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    g = ts.groupBy("series_id", F.window("ts", step)).agg(F.avg("load").alias("avg_load"), F.count("*").alias("n"))
    return g.select("series_id", F.col("window.start").alias("timestamp"), "avg_load", "n")
