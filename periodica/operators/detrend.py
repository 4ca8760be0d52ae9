"""Detrending that is plain SQL: block lines and polynomials from power sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_blocks(bars: DataFrame, column: str, window: int) -> DataFrame:
    """Residual of one line per block of `window` bars, after the first n % window; window 0 takes one line over all."""
    w = Window.partitionBy("series_id")
    rows = bars.withColumn("skipped", F.count("*").over(w) % window if window else F.lit(0)).where("bar_idx >= skipped")
    rows = rows.withColumn("block", F.floor((F.col("bar_idx") - F.col("skipped")) / (window or 2**62)))
    b = Window.partitionBy("series_id", "block")
    x, y = F.col("bar_idx").cast("double"), F.col(column)
    mx, my = F.avg(x).over(b), F.avg(y).over(b)
    rows = rows.withColumn("mx", mx).withColumn("my", my)
    sxy, sxx = F.sum((x - F.col("mx")) * (y - F.col("my"))).over(b), F.sum((x - F.col("mx")) ** 2).over(b)
    rows = rows.withColumn("slope", F.coalesce(sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0)))
    return rows.select("series_id", "bar_idx", "block", (y - F.col("my") - F.col("slope") * (x - F.col("mx"))).alias("detrended"))


def quadratic(bars: DataFrame, column: str) -> DataFrame:
    """Residual of a parabola: positions are centred, so that odd power sums vanish and two equations remain."""
    w = Window.partitionBy("series_id")
    rows = bars.withColumn("x", F.col("bar_idx") - F.avg("bar_idx").over(w)).withColumn("q", F.col("x") * F.col("x"))
    rows = rows.withColumn("mq", F.avg("q").over(w)).withColumn("my", F.avg(column).over(w)).withColumn("dq", F.col("q") - F.col("mq"))
    b1 = F.sum(F.col("x") * F.col(column)).over(w) / F.nullif(F.sum("q").over(w), F.lit(0.0))
    b2 = F.sum(F.col("dq") * (F.col(column) - F.col("my"))).over(w) / F.nullif(F.sum(F.col("dq") * F.col("dq")).over(w), F.lit(0.0))
    return rows.select("series_id", "bar_idx", (F.col(column) - F.col("my") - F.coalesce(b1, F.lit(0.0)) * F.col("x") - F.coalesce(b2, F.lit(0.0)) * F.col("dq")).alias("detrended"))


def none(bars: DataFrame, column: str) -> DataFrame:
    return bars.select("series_id", "bar_idx", F.col(column).alias("detrended"))
