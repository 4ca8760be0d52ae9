"""As-of cuts, windows of the last bars, null handling and derived columns of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import in_order


class MissingAsOfError(ValueError):
    """No bar at the as-of time, nor on its date."""


def as_of_cut(bars: DataFrame, as_of: str) -> DataFrame:
    """Bars up to a time."""
    return bars.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))


def as_of_bar(bars: DataFrame, as_of: str) -> DataFrame:
    """Per series the bar at the as-of time, else the last one on that date: series_id, as_of_idx, as_of_ts."""
    at = F.lit(as_of).cast("timestamp_ntz")
    near = bars.where(F.to_date("ts") == F.to_date(at)).withColumn("exact", (F.col("ts") == at).cast("int"))
    order = F.struct("exact", "ts")
    return near.groupBy("series_id").agg(F.max_by("bar_idx", order).alias("as_of_idx"), F.max_by("ts", order).alias("as_of_ts"))


def require_as_of(bars: DataFrame, as_of: str) -> DataFrame:
    found = as_of_bar(bars, as_of)
    if found.isEmpty():
        raise MissingAsOfError(f"no bar on {as_of}")
    return found


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of every series that has so many, with m = 0..n-1 and the bounds of the rebuilt signal."""
    last = F.max("bar_idx").over(Window.partitionBy("series_id"))
    rows = bars.withColumn("last_idx", last).where((F.col("last_idx") >= n - 1) & (F.col("bar_idx") > F.col("last_idx") - n))
    return rows.withColumn("m", F.col("bar_idx") - F.col("last_idx") + n - 1).withColumn("start_idx", F.col("last_idx") - n + 1).withColumn("end_idx", F.col("last_idx") + n)


def protective_cut(bars: DataFrame, bands: DataFrame) -> DataFrame:
    """Bars from last - int(1.5 * num_samples) on, of the band with the largest max_period; positions are counted anew."""
    widest = bands.agg(F.max_by("num_samples", F.struct("max_period", -F.col("band"))).alias("num_samples"))
    last = F.max("bar_idx").over(Window.partitionBy("series_id"))
    rows = bars.withColumn("last_idx", last).crossJoin(F.broadcast(widest)).where(F.col("bar_idx") >= F.col("last_idx") - F.expr("cast(1.5 * num_samples as int)"))
    return rows.withColumn("bar_idx", F.row_number().over(in_order()).cast("long") - 1).drop("last_idx", "num_samples")


def at_dates(bars: DataFrame, dates: DataFrame, keep: int) -> DataFrame:
    """For each series and date (as_of) the last `keep` bars up to it, as a series of its own: series_id is series@date, bar_idx counts anew.

    The last bar of each date comes from one sort of bars and dates together; then exactly the wanted bars are joined.
    """
    when = F.col("as_of").cast("timestamp_ntz")
    asked = bars.select("series_id").distinct().crossJoin(F.broadcast(dates.select("as_of").distinct()))  # a row per series and date
    both = bars.select("series_id", "ts", "bar_idx", F.lit(None).cast("string").alias("as_of")).unionByName(asked.select("series_id", when.alias("ts"), F.lit(None).cast("long").alias("bar_idx"), "as_of"))
    order = Window.partitionBy("series_id").orderBy("ts", F.col("as_of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("last_idx", F.last("bar_idx", True).over(order)).where("as_of IS NOT NULL AND last_idx IS NOT NULL").select("series_id", "as_of", "last_idx")
    wanted = at.withColumn("bar_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("last_idx") - keep + 1), F.col("last_idx"))))
    rows = bars.join(wanted, ["series_id", "bar_idx"]).withColumn("bar_idx", F.col("bar_idx") - F.greatest(F.lit(0), F.col("last_idx") - keep + 1))
    return rows.withColumn("series_id", F.concat_ws("@", "series_id", "as_of")).select(*bars.columns)


def fill_null(bars: DataFrame, column: str) -> DataFrame:
    return bars.withColumn(column, F.coalesce(F.nanvl(F.col(column), F.lit(0.0)), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def bar_features(bars: DataFrame) -> DataFrame:
    """Differences within a bar, range per volume, and change of close per change of volume."""
    before = {c: F.lag(c).over(in_order()) for c in ("close", "volume")}
    return bars.select(
        "series_id", "bar_idx",
        (F.col("close") - F.col("open")).alias("co"), (F.col("high") - F.col("low")).alias("hl"), (F.col("close") - F.col("low")).alias("cl"),
        (F.col("close") - F.col("high")).alias("ch"), (F.col("high") - F.col("open")).alias("ho"), (F.col("open") - F.col("low")).alias("ol"),
        ratio(F.col("high") - F.col("low"), F.col("volume")).alias("hl_volume"),
        ratio(F.col("close") - before["close"], F.col("volume") - before["volume"]).alias("dclose_dvolume"),
        *[F.coalesce(F.col(c) - F.lag(c).over(in_order()), F.lit(0.0)).alias(f"d{c}") for c in ("open", "high", "low", "close", "volume")],
    )


def difference(bars: DataFrame, column: str) -> DataFrame:
    """First differences, 0 for a series' first bar."""
    return bars.withColumn("diff", F.coalesce(F.col(column) - F.lag(column).over(in_order()), F.lit(0.0)))


def zscore(bars: DataFrame, column: str) -> DataFrame:
    """Population z-score per series; a constant series has scale 1."""
    w = Window.partitionBy("series_id")
    sd = F.stddev_pop(column).over(w)
    return bars.withColumn("z", (F.col(column) - F.avg(column).over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def minmax(bars: DataFrame, column: str, low: float = -1.0, high: float = 1.0, *by: str) -> DataFrame:
    """Scaled to [low, high] per series; a constant series has scale 1."""
    w = Window.partitionBy("series_id", *by)
    least, width = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return bars.withColumn("scaled", (F.col(column) - least) / F.when(width > 0, width).otherwise(1.0) * (high - low) + low)


def centered_mean(column: str, window: int) -> Column:
    """Mean of a full window around a bar; an even window reaches one further back."""
    w = in_order().rowsBetween(-(window // 2), (window - 1) // 2)
    return F.when(F.count(column).over(w) == window, F.avg(column).over(w))


def centered_delta(bars: DataFrame, column: str, period: float) -> DataFrame:
    """Short minus long centred mean; windows are the period and half of it, rounded half to even."""
    return bars.withColumn("delta", centered_mean(column, round(period / 2)) - centered_mean(column, round(period)))


def band_lambdas(bands: DataFrame) -> DataFrame:
    """lambda_min of each band: given, else the lambda of the band that ends where this one begins, else from min_period."""
    other = bands.select(F.col("max_period").alias("ends"), F.col("hp_lambda").alias("near")).groupBy("ends").agg(F.min("near").alias("near"))
    formula = 1 / (16 * F.pow(F.sin(F.lit(3.141592653589793) / F.greatest(F.lit(2), F.floor("min_period"))), 4))
    given = [F.col("lambda_min")] if "lambda_min" in bands.columns else []
    return bands.join(F.broadcast(other), F.col("min_period") == F.col("ends"), "left").withColumn("low_lambda", F.coalesce(*given, "near", formula)).drop("ends", "near", "lambda_min").withColumnRenamed("low_lambda", "lambda_min")
