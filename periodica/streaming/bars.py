"""Bars from a stream of observations, and analyses as bars close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bars(events: DataFrame, series: Column, ts: str, value: str, tie: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream; a bar closes when the watermark has passed its end, later observations are dropped."""
    at = F.struct(F.col(ts), F.col(tie))
    timed = events.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    bars = timed.groupBy(F.window(ts, length).alias("w"), series.alias("series_id")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def on_close(bars: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of closed bars to `act`, then stop when the source is read."""
    return bars.writeStream.outputMode("append").foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
