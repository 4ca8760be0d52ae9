"""Sinusoids of chosen cycles over time, their sum, fits and fidelity."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .spectrum import amplitude_phase


def sinusoids(cycles: DataFrame, n: int) -> DataFrame:
    """Long form of cycles (series_id, cycle_id, amplitude, frequency, phase, start_idx): value at bars start..start + 2n - 1, `best_` columns first where not null."""
    best = lambda c: F.coalesce(F.col(f"best_{c}"), F.col(c)) if f"best_{c}" in cycles.columns else F.col(c)
    rows = cycles.select("series_id", "cycle_id", "start_idx", best("amplitude").alias("amplitude"), best("frequency").alias("frequency"), best("phase").alias("phase"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))))
    value = F.col("amplitude") * F.sin(2 * math.pi * F.col("frequency") * F.col("t") + F.col("phase"))
    return rows.select("series_id", "cycle_id", (F.col("start_idx") + F.col("t")).alias("bar_idx"), value.alias("value"))


def recent_only(signals: DataFrame, cycles: DataFrame, last: DataFrame, multiplier: float) -> DataFrame:
    """signals with 0 where a cycle lies further back than `multiplier` periods from the series' last_idx."""
    frequency = F.coalesce("best_frequency", "frequency") if "best_frequency" in cycles.columns else F.col("frequency")
    begin = cycles.select("series_id", "cycle_id", F.floor(F.lit(multiplier) / frequency).alias("length")).join(last.select("series_id", "last_idx"), "series_id")
    rows = signals.join(begin.select("series_id", "cycle_id", (F.col("last_idx") + 1 - F.col("length")).alias("begin")), ["series_id", "cycle_id"])
    return rows.select("series_id", "cycle_id", "bar_idx", F.when(F.col("bar_idx") >= F.col("begin"), F.col("value")).otherwise(0.0).alias("value"))


def composite(signals: DataFrame) -> DataFrame:
    return signals.groupBy("series_id", "bar_idx").agg(F.sum("value").alias("composite"))


def aligned(bars: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Outer join by position, 0 where there is no value; is_projected marks positions past the bars."""
    rows = bars.select("series_id", "bar_idx", F.lit(True).alias("observed")).join(values, ["series_id", "bar_idx"], "full")
    return rows.select("series_id", "bar_idx", F.coalesce(F.col(column), F.lit(0.0)).alias(column), F.col("observed").isNull().alias("is_projected"))


def fidelity(rows: DataFrame, signal: str, reference: str) -> DataFrame:
    """Pearson correlation and normalised error per series, 4 decimals; null under 8 points or without variance."""
    ok = (F.count("*") >= 8) & (F.var_pop(reference) > 0) & (F.var_pop(signal) > 0)
    gap = (F.col(signal) - F.col(reference)) ** 2
    return rows.where(F.col(signal).isNotNull() & F.col(reference).isNotNull()).groupBy("series_id").agg(
        F.when(ok, F.round(F.corr(signal, reference), 4)).alias("correlation"), F.when(ok, F.round(F.avg(gap) / F.var_pop(reference), 4)).alias("nmse")
    )


def scaled_to(rows: DataFrame, signal: str, reference: str, tail: int, method: str = "lsq") -> DataFrame:
    """signal as a + b * signal, fitted to reference over the last `tail` bars: by least squares, or so that least and greatest values agree (`minmax`)."""
    last = F.max("bar_idx").over(Window.partitionBy("series_id"))
    at = rows.withColumn("last_idx", last).where(F.col("bar_idx") > F.col("last_idx") - tail)
    if method == "lsq":
        fit = at.groupBy("series_id").agg(F.regr_slope(reference, signal).alias("b"), F.regr_intercept(reference, signal).alias("a"))
    elif method == "minmax":
        slope = (F.max(reference) - F.min(reference)) / F.nullif(F.max(signal) - F.min(signal), F.lit(0.0))
        fit = at.groupBy("series_id").agg(slope.alias("b"), (F.min(reference) - slope * F.min(signal)).alias("a"))
    else:
        raise ValueError(f"unknown scaling: {method}")
    return rows.join(fit, "series_id").withColumn("fitted", F.col("a") + F.col("b") * F.col(signal))


def tail_mse(rows: DataFrame, signal: str, reference: str, start: int) -> DataFrame:
    return rows.where(F.col("bar_idx") >= start).groupBy("series_id").agg(F.avg((F.col(signal) - F.col(reference)) ** 2).alias("mse"))


def reestimated(reference: DataFrame, cycles: DataFrame) -> DataFrame:
    """cycles with amplitude and phase anew: the transform of reference (series_id, bar_idx, value) at each cycle's frequency from its start on."""
    rows = reference.select("series_id", "bar_idx", "value").join(cycles.select(*[F.col(c).alias(c) for c in ("series_id", "cycle_id", "frequency", "start_idx")]), "series_id").where(F.col("bar_idx") >= F.col("start_idx"))
    angle = 2 * math.pi * F.col("frequency") * (F.col("bar_idx") - F.col("start_idx"))
    sums = rows.groupBy("series_id", "cycle_id").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), (-F.sum(F.col("value") * F.sin(angle))).alias("im"))
    amp, phase = amplitude_phase(F.col("re"), F.col("im"))
    return cycles.drop("amplitude", "phase").join(sums.select("series_id", "cycle_id", amp.alias("amplitude"), phase.alias("phase")), ["series_id", "cycle_id"], "left")


def fit_cycles(reference: DataFrame, cycles: DataFrame, fit: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """cycles with best_amplitude, best_frequency, best_phase and loss from fit(reference values, cycles), one group per series.

    reference: series_id, bar_idx, value. start_idx of a cycle is a position of the reference.
    """

    def run(ref: pd.DataFrame, cyc: pd.DataFrame) -> pd.DataFrame:
        cyc = cyc.sort_values("cycle_id").reset_index(drop=True)
        if ref.empty or cyc.empty:
            return cyc.assign(best_amplitude=None, best_frequency=None, best_phase=None, loss=None).iloc[:0]
        ref = ref.sort_values("bar_idx")
        cyc["offset"] = np.clip(cyc["start_idx"] - ref["bar_idx"].iloc[0], 0, None)
        return fit(ref["value"].to_numpy(float), cyc)[["series_id", "cycle_id", "amplitude", "frequency", "phase", "start_idx", "best_amplitude", "best_frequency", "best_phase", "loss"]]

    schema = "series_id string, cycle_id long, amplitude double, frequency double, phase double, start_idx long, best_amplitude double, best_frequency double, best_phase double, loss double"
    left, right = reference.select("series_id", "bar_idx", "value"), cycles.select(*[F.col(c).alias(c) for c in ("series_id", "cycle_id", "amplitude", "frequency", "phase", "start_idx")])
    return left.groupBy("series_id").cogroup(right.groupBy("series_id")).applyInPandas(run, schema)


def algebraic(y: np.ndarray, cycles: pd.DataFrame) -> pd.DataFrame:
    start = cycles["offset"].to_numpy()
    amp, phase, _ = K.algebraic_fit(y, cycles["frequency"].to_numpy(), start)
    return cycles.assign(best_amplitude=amp, best_frequency=cycles["frequency"], best_phase=phase, loss=K.cycle_loss(y, amp, cycles["frequency"].to_numpy(), phase, start))


def varpro(y: np.ndarray, cycles: pd.DataFrame) -> pd.DataFrame:
    start = cycles["offset"].to_numpy()
    amp, freq, phase = K.varpro_fit(y, cycles["frequency"].to_numpy(), start)
    return cycles.assign(best_amplitude=amp, best_frequency=freq, best_phase=phase, loss=K.cycle_loss(y, amp, freq, phase, start))
