"""Grouped kernels: one series (or series and band) at a time, as a pandas frame in bar order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernels as K


def per_series(bars: DataFrame, column: str, names: list[str], fn: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """series_id, bar_idx and one double column per result of fn, NaN as null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        out = fn(pdf["value"].to_numpy(float))
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "bar_idx": pdf["bar_idx"].to_numpy(), **{n: pd.array(x, "Float64") for n, x in zip(names, out, strict=True)}})

    rows = bars.selectExpr("series_id", "bar_idx", f"cast({column} as double) as value")
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, bar_idx long, " + ", ".join(f"{n} double" for n in names))


def hp_filter(bars: DataFrame, column: str, lam: float) -> DataFrame:
    return per_series(bars, column, ["detrended"], lambda y: (K.hp_detrend(y, lam),))


def band_pass(bars: DataFrame, column: str, lam: float, lam_min: float) -> DataFrame:
    return per_series(bars, column, ["detrended"], lambda y: (K.band_pass(y, lam, lam_min),))


def jh_filter(bars: DataFrame, column: str, h: int, p: int) -> DataFrame:
    return per_series(bars, column, ["detrended"], lambda y: (K.lag_regression(y, h, p),))


def lowess_filter(bars: DataFrame, column: str, k: float, max_period: float) -> DataFrame:
    return per_series(bars, column, ["detrended"], lambda y: (y - K.lowess(y, int(k * max_period) / max(1, len(y))),))


def savgol(bars: DataFrame, column: str, window: int, order: int = 2) -> DataFrame:
    return per_series(bars, column, ["smoothed"], lambda y: (K.savgol(y, window, order),))


def macd(bars: DataFrame, column: str, fast: int = 12, slow: int = 26, signal: int = 9, smooth: int | None = None) -> DataFrame:
    """macd, signal, histogram; of the smoothed series if `smooth` is a Savitzky-Golay window."""
    return per_series(bars, column, ["macd", "signal", "histogram"], lambda y: K.macd(y if smooth is None else K.savgol(y, smooth), fast, slow, signal))


def rsi(bars: DataFrame, column: str, period: int = 14, smooth: int | None = None) -> DataFrame:
    """rsi, and its difference, of the smoothed index if `smooth` is a Savitzky-Golay window."""

    def both(y):
        r = K.rsi(y, period)
        r = r if smooth is None else K.savgol(r, smooth)
        return r, np.diff(r, prepend=r[:1])

    return per_series(bars, column, ["rsi", "rsi_diff"], both)
