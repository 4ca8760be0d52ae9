"""Turning points: labels around an as-of bar, previous and next extremum, the alignment indicator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectrum import local_extrema


def turning_points(rows: DataFrame, column: str, by: list[str] | None = None, order: int = 1) -> DataFrame:
    """The extrema of each series: kind 1 for a maximum, -1 for a minimum."""
    by = by or ["series_id"]
    found = local_extrema(rows, column, order, by, "bar_idx").where("is_max OR is_min")
    return found.select(*by, "bar_idx", F.col(column).alias("value"), F.when(F.col("is_max"), 1).otherwise(-1).alias("kind"))


def labelled(points: DataFrame, as_of: DataFrame, count: int) -> DataFrame:
    """The `count` extrema before and from the as-of bar on: label -1 for the nearest before, +1 for the nearest after.

    idx_delta counts bars from the as-of bar, contiguous_delta is the change from the extremum before.
    """
    rows = points.join(as_of.select("series_id", "as_of_idx"), "series_id")
    rows = rows.withColumn("late", F.col("bar_idx") >= F.col("as_of_idx")).withColumn("idx_delta", F.col("bar_idx") - F.col("as_of_idx"))
    rows = rows.withColumn("label", F.row_number().over(Window.partitionBy("series_id", "late").orderBy(F.abs("idx_delta"))))
    rows = rows.where(F.col("label") <= count).withColumn("label", F.when(F.col("late"), F.col("label")).otherwise(-F.col("label")))
    before = F.lag("value").over(Window.partitionBy("series_id").orderBy("bar_idx"))
    return rows.withColumn("contiguous_delta", F.abs(F.col("value") - before)).select("series_id", "label", "idx_delta", "kind", "value", "contiguous_delta")


def trend(labels: DataFrame) -> DataFrame:
    """1 if the last extremum before the as-of bar is a minimum, else -1."""
    return labels.where("label = -1").select("series_id", F.when(F.col("kind") == -1, 1).otherwise(-1).alias("trend"))


def neighbours(rows: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """rows with the extremum strictly before and after each bar: prev_idx, prev_kind, next_idx."""
    joined = rows.join(points.select(*by, "bar_idx", "kind"), [*by, "bar_idx"], "left")
    w = Window.partitionBy(*by).orderBy("bar_idx")
    mark = F.when(F.col("kind").isNotNull(), F.struct("bar_idx", "kind"))
    previous = F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(mark, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return joined.withColumn("p", previous).withColumn("f", following).select(*rows.columns, F.col("p.bar_idx").alias("prev_idx"), F.col("p.kind").alias("prev_kind"), F.col("f.bar_idx").alias("next_idx"))


def alignment(signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per bar the sum over cycles of the share of the way left to the next extremum: positive after a maximum, negative after a minimum.

    weights (series_id, cycle_id, weight) multiply each cycle's share, by the sum of the series' weights, or by the
    cycle's period if weights has that too.
    """
    by = ["series_id", "cycle_id"]
    rows = neighbours(signals.select(*by, "bar_idx"), turning_points(signals, "value", by), by)
    share = (F.col("next_idx") - F.col("bar_idx")) / (F.col("next_idx") - F.col("prev_idx")) * F.col("prev_kind")
    rows = rows.withColumn("share", F.coalesce(share, F.lit(0.0)))
    if weights is None:
        return rows.groupBy("series_id", "bar_idx").agg(F.sum("share").alias("alignment"))
    if "period" in weights.columns:
        weights = weights.select(*by, "weight", F.col("period").alias("total"))
    else:
        weights = weights.join(weights.groupBy("series_id").agg(F.sum("weight").alias("total")), "series_id")
    rows = rows.join(weights, by)
    return rows.groupBy("series_id", "bar_idx").agg(F.sum(F.col("share") * F.col("weight") / F.col("total")).alias("alignment"))
