"""Scores of candidate cycles and the choice of the dominant ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K


def average_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Mean rank of equal values; null where the value is null."""
    x = F.col(value)
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_last(value))
    same = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(x.isNotNull(), F.rank().over(w) + (same - 1) / 2)


def global_score(candidates: DataFrame, ascending: list[str], descending: list[str]) -> DataFrame:
    """Sum of average ranks over the scores that are there: larger values of `ascending` and smaller ones of `descending` rank higher."""
    ranks = [average_rank(c, ["series_id"]) for c in ascending if c in candidates.columns] + [average_rank(c, ["series_id"], True) for c in descending if c in candidates.columns]
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(r, F.lit(0.0))
    return candidates.withColumn("global_score", total)


def simpson(rows: DataFrame, column: str) -> DataFrame:
    """Simpson's integral per series at unit steps; of an even number of bars the last interval is a trapezium."""
    w = Window.partitionBy("series_id")
    x = rows.withColumn("i", F.row_number().over(w.orderBy("bar_idx")) - 1).withColumn("n", F.count("*").over(w))
    odd = F.col("n") - (1 - F.col("n") % 2)
    weight = F.when(F.col("i") >= odd, 0.0).when((F.col("i") == 0) | (F.col("i") == odd - 1), 1 / 3).when(F.col("i") % 2 == 1, 4 / 3).otherwise(2 / 3)
    tail = F.when((F.col("n") % 2 == 0) & (F.col("i") >= F.col("n") - 2), 0.5).otherwise(0.0)
    return x.groupBy("series_id").agg(F.sum(F.col(column) * (weight + tail)).alias("integral"))


def nearest_peaks(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """For each position of `dense` (series_id, pos) the nearest of `sparse`, the lower of two: by the last one before and the first one after, in one sort."""
    both = dense.select("series_id", "pos", F.lit(0).alias("s")).union(sparse.select("series_id", "pos", F.lit(1).alias("s")))
    w = Window.partitionBy("series_id").orderBy("pos")
    mark = F.when(F.col("s") == 1, F.col("pos"))
    before = F.last(mark, True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(mark, True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.when(before.isNull() | (after - F.col("pos") < F.col("pos") - before), after).otherwise(before)
    return both.withColumn("near", near).where("s = 0").select("series_id", "pos", "near", F.abs(F.col("pos") - F.col("near")).alias("distance"))


def peak_rmse(nearest: DataFrame, period: float) -> DataFrame:
    """Root mean square of the distances by the period; 1, a whole period, where there are no pairs."""
    return nearest.groupBy("series_id").agg((F.coalesce(F.sqrt(F.avg(F.col("distance") * F.col("distance"))), F.lit(float(period))) / period).alias("phase_rmse"))


def _gaps(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance from each position of the larger set to the nearest one of the smaller; nothing if either is empty."""
    few, many = sorted((one, other), key=len)
    if not len(few):
        return np.zeros(0)
    after = np.searchsorted(few, many)
    return np.minimum(np.abs(many - few[np.clip(after, 0, len(few) - 1)]), np.abs(many - few[np.clip(after - 1, 0, len(few) - 1)]))


def correlation_scores(series: pd.DataFrame, peaks: pd.DataFrame) -> pd.DataFrame:
    """For one series: the scores of every candidate against the difference of two Savitzky-Golay means, of one period and of two.

    savgol_corr and derivative_corr (by the number of the sine's turning points) are integrals of products, phase_rmse the
    distance of turning points, maxima to maxima and minima to minima, in periods (1 without any), peak_ratio the
    difference of their numbers by the period.
    """
    y = series.sort_values("m")["x"].to_numpy(float)
    n, out = len(y), []
    t = np.linspace(0, n, n)
    z = lambda v: (v - v.mean()) / (v.std() or 1.0)
    for p in peaks.itertuples():
        sine = z(np.sin(2 * np.pi * p.frequency * t + p.phase))
        delta = z(K.savgol(y, max(1, int(p.period)), 2) - K.savgol(y, max(1, int(2 * p.period)), 2))
        (tops, lows), (tops_d, lows_d) = (K.turning_points(v, max(1, int(p.period / 2))) for v in (sine, delta))
        gaps = np.concatenate([_gaps(tops, tops_d), _gaps(lows, lows_d)])
        rmse = float(np.sqrt((gaps**2).mean())) / p.period if len(gaps) else 1.0
        turns, turns_d = len(tops) + len(lows), len(tops_d) + len(lows_d)
        slope = K.simpson(np.diff(sine, prepend=sine[:1]) * np.diff(delta, prepend=delta[:1]))
        out.append((p.series_id, p.k, K.simpson(sine * delta), slope / turns if turns else None, rmse, abs(turns - turns_d) / p.period))
    return pd.DataFrame(out, columns=["series_id", "k", "savgol_corr", "derivative_corr", "phase_rmse", "peak_ratio"])


def scored(window: DataFrame, peaks: DataFrame) -> DataFrame:
    """peaks with the correlation scores, one group per series."""
    schema = "series_id string, k long, savgol_corr double, derivative_corr double, phase_rmse double, peak_ratio double"
    own = peaks.select(*[F.col(c).alias(c) for c in ("series_id", "k", "frequency", "period", "phase")])  # both sides may come from one frame
    found = window.select("series_id", "m", "x").groupBy("series_id").cogroup(own.groupBy("series_id")).applyInPandas(correlation_scores, schema)
    return peaks.join(found, ["series_id", "k"], "left")


def dominant(candidates: DataFrame, count: int, by: str = "global_score") -> DataFrame:
    """The best `count` cycles per series, and the longest kept period as dominant_period."""
    w = Window.partitionBy("series_id").orderBy(F.desc_nulls_last(by), "k")
    kept = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
    return kept.withColumn("dominant_period", F.max("period").over(Window.partitionBy("series_id")))
