"""Bar frames: series_id, ts, open, high, low, close, volume, bar_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)


class EmptySeriesError(ValueError):
    """A source that gives no bars."""


def in_order(*extra: str) -> Window:
    """The window of one series in the order of its bars."""
    return Window.partitionBy("series_id", *extra).orderBy("bar_idx")


def indexed(bars: DataFrame) -> DataFrame:
    """bars with bar_idx, the 0-based position within the series by time."""
    return bars.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).cast("long"))


def resample(rows: DataFrame, series: Column, ts: str, value: str, tie: str, unit: str) -> DataFrame:
    """Bars of `unit` length from single observations; ties in time are ordered by `tie`."""
    at = F.struct(F.col(ts), F.col(tie))
    return indexed(
        rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
        .groupBy(series.alias("series_id"), F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


def hourly_events(spark: SparkSession, sf_dir: str, per_type: bool = True) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return resample(events, F.col("event_type") if per_type else F.lit("all"), "ts", "value", "event_id", "hour")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    return resample(orders, F.lit("orders"), "o_orderdate", "o_totalprice", "o_orderkey", "day")


def read_csv(spark: SparkSession, path: str, series_id: str, source_tz: str | None = None) -> DataFrame:
    """Bars from a CSV file with a Datetime column; with source_tz, times are converted from that zone to UTC."""
    schema = "Datetime string, Open double, High double, Low double, Close double, Volume double"
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    ts = F.to_timestamp_ntz("Datetime") if source_tz is None else F.convert_timezone(F.lit(source_tz), F.lit("UTC"), F.to_timestamp_ntz("Datetime"))
    bars = rows.select(F.lit(series_id).alias("series_id"), ts.alias("ts"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")])
    return indexed(bars)


def span(bars: DataFrame) -> DataFrame:
    """First and last time and number of bars of each series."""
    return bars.groupBy("series_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"))


def require(bars: DataFrame) -> DataFrame:
    if bars.isEmpty():
        raise EmptySeriesError("the source gives no bars")
    return bars
