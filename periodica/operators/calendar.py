"""Future bar times from the weekdays and times of day that a series has had."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cadence(bars: DataFrame) -> DataFrame:
    """Median and most frequent seconds between bars of each series."""
    gap = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts")).cast("timestamp"))).cast("double")
    return bars.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("series_id").agg(F.median("gap").alias("median_gap"), F.mode("gap", True).alias("mode_gap"))


def weekdays(bars: DataFrame) -> DataFrame:
    """Weekdays (0 Monday) on which a series has bars."""
    return bars.select("series_id", F.weekday("ts").alias("weekday")).distinct()


def _future(bars: DataFrame, n: int) -> DataFrame:
    """Days after each series' last one: at least one weekday a week is known, so 7 n + 7 days hold n."""
    last = bars.groupBy("series_id").agg(F.to_date(F.max("ts")).alias("last_day"))
    return last.select("series_id", F.explode(F.sequence(F.date_add("last_day", 1), F.date_add("last_day", 7 * n + 7))).alias("day")).withColumn("weekday", F.weekday("day"))


def extend_daily(bars: DataFrame, n: int) -> DataFrame:
    """The next n days on weekdays that the series has: series_id, step, ts."""
    days = _future(bars, n).join(weekdays(bars), ["series_id", "weekday"], "left_semi")
    step = F.row_number().over(Window.partitionBy("series_id").orderBy("day"))
    return days.withColumn("step", step).where(F.col("step") <= n).select("series_id", "step", F.col("day").cast("timestamp_ntz").alias("ts"))


def extend_intraday(bars: DataFrame, n: int) -> DataFrame:
    """The next n times: each future day takes the times of the last day of its type (Friday, Saturday, Sunday, other) that came before the last, maybe unfinished, one.

    Day types the series never had get no times.
    """
    kind = F.when(F.col("weekday") == 4, "friday").when(F.col("weekday") == 5, "saturday").when(F.col("weekday") == 6, "sunday").otherwise("workday")
    rows = bars.select("series_id", "ts", F.to_date("ts").alias("day")).withColumn("weekday", F.weekday("day")).withColumn("kind", kind)
    rows = rows.withColumn("last_day", F.max("day").over(Window.partitionBy("series_id")))
    full = rows.where("day < last_day").withColumn("model", F.max("day").over(Window.partitionBy("series_id", "kind"))).where("day = model")
    times = full.select("series_id", "kind", F.datediff("day", "day").alias("zero"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("at")).drop("zero")
    days = _future(bars, n).withColumn("kind", kind)
    future = days.join(times, ["series_id", "kind"]).withColumn("ts", F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, 0, 0, at)"))
    step = F.row_number().over(Window.partitionBy("series_id").orderBy("ts"))
    return future.withColumn("step", step).where(F.col("step") <= n).select("series_id", "step", "ts")
