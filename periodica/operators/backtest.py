"""Profit and loss of trades on projected turning points, folds over dates, and stored parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_turns(points: DataFrame, as_of: DataFrame) -> DataFrame:
    """First maximum and first minimum after the as-of bar."""
    later = points.join(as_of.select("series_id", "as_of_idx"), "series_id").where("bar_idx > as_of_idx")
    return later.groupBy("series_id").agg(F.min(F.when(F.col("kind") == 1, F.col("bar_idx"))).alias("max_idx"), F.min(F.when(F.col("kind") == -1, F.col("bar_idx"))).alias("min_idx"))


def trade(bars: DataFrame, turns: DataFrame, *by: str) -> DataFrame:
    """close one bar after the maximum less close one bar after the minimum; 0 if either is missing."""
    prices = bars.select("series_id", (F.col("bar_idx") - 1).alias("at"), "close")
    high = turns.join(prices.select("series_id", F.col("at").alias("max_idx"), F.col("close").alias("sold")), ["series_id", "max_idx"], "left")
    both = high.join(prices.select("series_id", F.col("at").alias("min_idx"), F.col("close").alias("bought")), ["series_id", "min_idx"], "left")
    return both.select("series_id", *by, "max_idx", "min_idx", F.coalesce(F.col("sold") - F.col("bought"), F.lit(0.0)).alias("pl"))


def fold(trades: DataFrame) -> DataFrame:
    """Sums over dates (series_id, as_of, pl): total, worst loss, worst running loss (cleared by each profit), profits, losses, ratios."""
    w = Window.partitionBy("series_id").orderBy("as_of")
    rows = trades.withColumn("island", F.sum((F.col("pl") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    running = F.sum(F.least(F.col("pl"), F.lit(0.0))).over(Window.partitionBy("series_id", "island").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("running", running)
    won, lost = F.when(F.col("pl") > 0, F.col("pl")), F.when(F.col("pl") < 0, F.col("pl"))
    out = rows.groupBy("series_id").agg(
        F.sum("pl").alias("pl_sum"), F.least(F.lit(0.0), F.min("pl")).alias("worst_loss"), F.least(F.lit(0.0), F.min("running")).alias("worst_running_loss"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("profit_sum"), F.count(won).alias("profits"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("loss_sum"), F.count(lost).alias("losses"),
    )
    return out.withColumn("profit_ratio", F.col("profit_sum") / F.nullif(-F.col("loss_sum"), F.lit(0.0))).withColumn("win_share", F.col("profits") / F.nullif(F.col("profits") + F.col("losses"), F.lit(0)))


def positive_mean(rows: DataFrame) -> DataFrame:
    """Sum of fitness over the number of positive ones."""
    return rows.groupBy("series_id").agg((F.sum("fitness") / F.nullif(F.count_if(F.col("fitness") > 0), F.lit(0))).alias("fitness"))


def pick_parameters(history: DataFrame, as_of: str, by: str = "optimization_label", keep: str | None = None) -> DataFrame:
    """Per label, of the rows at the latest date not after as_of, the one with the least fitness; nothing from an empty history."""
    rows = history.where(F.col("analysis_reference_date") <= F.lit(as_of).cast("timestamp_ntz"))
    rows = rows.where(keep) if keep else rows
    w = Window.partitionBy(by).orderBy(F.desc("analysis_reference_date"), F.asc("fitness"), "parameter_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
