"""Goertzel spectra as sums over bars and frequencies, spectral peaks and the Bartels score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windowing import last_bars


def grid_size(n: int, min_period: float | None, max_period: float | None) -> tuple[int, int]:
    """Number of frequencies k / (max_period * n), and max_period; missing bounds are 5 and n / 5."""
    low = 5 if min_period is None else min_period
    high = int(n / 5) if max_period is None else int(max_period)
    return int(n / low * 2) * high - 1, high


def frequency_grid(spark: SparkSession, n: int, min_period: float | None, max_period: float | None) -> DataFrame:
    size, high = grid_size(n, min_period, max_period)
    return spark.range(1, size + 1).select(F.col("id").alias("k"), (F.col("id") / (high * n)).alias("frequency"), (high * n / F.col("id")).alias("period"))


def kaiser(n: int, beta: float) -> list[float]:
    return np.kaiser(n, beta).tolist()


def tapered(window: DataFrame, column: str, n: int, beta: float) -> DataFrame:
    """column times a Kaiser weight by m."""
    weights = window.sparkSession.createDataFrame(list(enumerate(kaiser(n, beta))), "m long, weight double")
    return window.join(F.broadcast(weights), "m").withColumn("tapered", F.col(column) * F.col("weight"))


def amplitude_phase(re: Column, im: Column) -> tuple[Column, Column]:
    """2 * |sum| and the phase of amp * sin(2 pi f m + phase)."""
    return 2 * F.sqrt(re * re + im * im), math.pi / 2 + F.atan2(im, re)


def spectrum(window: DataFrame, grid: DataFrame, column: str) -> DataFrame:
    """series_id, k, frequency, period, amplitude, phase from window rows (series_id, m, column).

    The grid is small whatever the number of series, and is broadcast; products are summed as they are
    made, so that no more than one row per series and frequency leaves a task.
    """
    angle = 2 * math.pi * F.col("frequency") * F.col("m")
    sums = window.select("series_id", "m", column).crossJoin(F.broadcast(grid)).groupBy("series_id", "k", "frequency", "period").agg(
        F.sum(F.col(column) * F.cos(angle)).alias("re"), (-F.sum(F.col(column) * F.sin(angle))).alias("im")
    )
    amp, phase = amplitude_phase(F.col("re"), F.col("im"))
    return sums.select("series_id", "k", "frequency", "period", amp.alias("amplitude"), phase.alias("phase"))


def spectrum_kernel(window: DataFrame, n: int, min_period: float, max_period: float, column: str) -> DataFrame:
    """The same by one matrix product per batch of series: for very many series."""
    size, high = grid_size(n, min_period, max_period)
    rows = window.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", F.col(column).alias("x")))), lambda z: z["x"]).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = np.arange(1, size + 1)
        angle = 2 * np.pi * np.outer(np.arange(n), k / (high * n))
        cos, sin = np.cos(angle), np.sin(angle)
        for batch in batches:
            x = np.array(batch["x"].tolist())
            re, im = x @ cos, -(x @ sin)
            yield pd.DataFrame({
                "series_id": np.repeat(batch["series_id"].to_numpy(), size), "k": np.tile(k, len(batch)), "frequency": np.tile(k / (high * n), len(batch)),
                "period": np.tile(high * n / k, len(batch)), "amplitude": (2 * np.hypot(re, im)).ravel(), "phase": (np.pi / 2 + np.arctan2(im, re)).ravel(),
            })

    return rows.mapInPandas(run, "series_id string, k long, frequency double, period double, amplitude double, phase double")


def offsets(spectral: DataFrame, n: int) -> DataFrame:
    """Bars from the window's end to the next minimum and maximum of each component."""
    turn = 2 * math.pi
    at = F.pmod(turn * F.col("frequency") * F.pmod(F.lit(float(n)), F.col("period")) + F.col("phase"), F.lit(turn))
    wait = lambda target: F.pmod(F.lit(target) - at, F.lit(turn)) / (turn * F.col("frequency"))
    return spectral.withColumn("min_offset", wait(1.5 * math.pi)).withColumn("max_offset", wait(0.5 * math.pi))


def generalized_goertzel(x: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Complex results at fractional bins: the recursion ends with one more step that reads the last sample again; all bins run side by side."""
    a = 2 * np.pi * np.atleast_1d(bins) / len(x)
    c, s1, s2 = 2 * np.cos(a), np.zeros(len(a)), np.zeros(len(a))
    for v in x:
        s1, s2 = v + c * s1 - s2, s1
    s0 = x[-1] + c * s1 - s2
    return (s0 - s1 * np.exp(-1j * a)) * np.exp(-1j * a * (len(x) - 1))


def local_extrema(rows: DataFrame, column: str, order: int, by: list[str], position: str) -> DataFrame:
    """is_max and is_min: strictly beyond all `order` neighbours on each side; ends never qualify."""
    w = Window.partitionBy(*by).orderBy(position)
    before, after = w.rowsBetween(-order, -1), w.rowsBetween(1, order)
    x = F.col(column)
    top = (x > F.max(x).over(before)) & (x > F.max(x).over(after))
    low = (x < F.min(x).over(before)) & (x < F.min(x).over(after))
    return rows.withColumn("is_max", F.coalesce(top, F.lit(False))).withColumn("is_min", F.coalesce(low, F.lit(False)))


def spectral_peaks(spectral: DataFrame, order: int = 10) -> DataFrame:
    found = local_extrema(spectral, "amplitude", order, ["series_id"], "k").where("is_max").drop("is_max", "is_min")
    return found.withColumn("scaled_amplitude", F.col("amplitude") * F.col("frequency"))


def period_filter(peaks: DataFrame, min_period: float, max_period: float, first: int | None = None) -> DataFrame:
    """Peaks with a period in range, or the first few by frequency."""
    if first is not None:
        return peaks.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy("k"))).where(F.col("n") <= first).drop("n")
    return peaks.where(F.col("period").between(min_period, max_period))


def bartels(series: DataFrame, peaks: DataFrame, column: str, max_segments: int = 30) -> DataFrame:
    """peaks with bartels_score and significance = 1 - score.

    Segments are floor(x / int(L)) of 0-based positions, complete ones only, at most max_segments. The
    score is near 0 for a true cycle and grows towards 1 without one.
    """
    # positions count from the start of `series`
    rows = series.withColumn("x", F.row_number().over(Window.partitionBy("series_id").orderBy("bar_idx")) - 1).withColumn("n_all", F.count("*").over(Window.partitionBy("series_id")))
    length = F.floor("period").cast("long")
    joined = rows.select("series_id", "x", "n_all", F.col(column).alias("v")).join(peaks.select("series_id", "k", "period"), "series_id")
    joined = joined.withColumn("segment", F.floor(F.col("x") / length)).withColumn("segments", F.least(F.floor(F.col("n_all") / length), F.lit(max_segments)))
    joined = joined.where("segment < segments")
    angle = 2 * math.pi * (F.col("x") + 1) / F.col("period")
    sums = joined.groupBy("series_id", "k", "segment").agg(F.sum(F.col("v") * F.sin(angle)).alias("a"), F.sum(F.col("v") * F.cos(angle)).alias("b"))
    each = sums.groupBy("series_id", "k").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("mm"), F.count("*").alias("s"))
    b1 = F.sqrt(F.col("ma") ** 2 + F.col("mb") ** 2) / F.nullif(F.sqrt("mm") / F.sqrt("s"), F.lit(0.0))
    each = each.select("series_id", "k", F.exp(-b1 * b1).alias("bartels_score"))
    return peaks.join(each, ["series_id", "k"], "left").withColumn("significance", 1 - F.col("bartels_score"))


def single_spectrum(bars: DataFrame, n: int, min_period: float, max_period: float, column: str = "close") -> DataFrame:
    """Last n bars, less their mean, to a spectrum."""
    window = last_bars(bars, n)
    window = window.withColumn("x", F.col(column) - F.avg(column).over(Window.partitionBy("series_id")))
    return spectrum(window, frequency_grid(bars.sparkSession, n, min_period, max_period), "x")


def top_cycles(peaks: DataFrame, count: int, by: str = "scaled_amplitude") -> DataFrame:
    """The best cycles of each series, rank 1 first; ties go to the lower k."""
    w = Window.partitionBy("series_id").orderBy(F.desc_nulls_last(by), "k")
    return peaks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
