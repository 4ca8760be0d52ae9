"""NumPy kernels for what has no DataFrame form: recurrences and matrix fits. One array is one series in order."""

from __future__ import annotations

import numpy as np


def hp_detrend(y: np.ndarray, lam: float) -> np.ndarray:
    """y less its Hodrick-Prescott trend, by elimination in the five diagonals of I + lam * D'D."""
    y = np.nan_to_num(np.asarray(y, float))
    n = len(y)
    if n <= 5:
        return np.full(n, np.nan)  # too short for a trend
    d = np.full(n, 1 + 6 * lam)
    d[[0, -1]], d[[1, -2]] = 1 + lam, 1 + 5 * lam
    e = np.full(n - 1, -4 * lam)
    e[[0, -1]] = -2 * lam
    # L D L': unit lower triangle with two subdiagonals
    piv, low1, low2, z = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        low2[i] = lam / piv[i - 2] if i > 1 else 0.0
        low1[i] = (e[i - 1] - (low2[i] * piv[i - 2] * low1[i - 1] if i > 1 else 0.0)) / piv[i - 1] if i else 0.0
        piv[i] = d[i] - (low1[i] ** 2 * piv[i - 1] if i else 0.0) - (low2[i] ** 2 * piv[i - 2] if i > 1 else 0.0)
        z[i] = y[i] - (low1[i] * z[i - 1] if i else 0.0) - (low2[i] * z[i - 2] if i > 1 else 0.0)
    t = z / piv
    for i in range(n - 2, -1, -1):
        t[i] -= low1[i + 1] * t[i + 1] + (low2[i + 2] * t[i + 2] if i + 2 < n else 0.0)
    return y - t


def band_pass(y: np.ndarray, lam: float, lam_min: float) -> np.ndarray:
    return hp_detrend(y, lam) - hp_detrend(y, lam_min)


def ols_residual(y: np.ndarray, design: np.ndarray) -> np.ndarray:
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


def lag_regression(y: np.ndarray, h: int, p: int) -> np.ndarray:
    """Residual of y[t + h] on 1, y[t], ..., y[t - p + 1]; NaN where the lags are not there."""
    y, out = np.asarray(y, float), np.full(len(y), np.nan)
    t = np.arange(p - 1, len(y) - h)
    if len(t) > p + 1:
        design = np.column_stack([np.ones(len(t)), *[y[t - j] for j in range(p)]])
        out[t + h] = ols_residual(y[t + h], design)
    return out


def lowess(y: np.ndarray, frac: float, robust: int = 3) -> np.ndarray:
    """Local linear fit with tricube weights of the nearest frac * n points, and bisquare reweighting."""
    y = np.asarray(y, float)
    n, x = len(y), np.arange(len(y), dtype=float)
    k = int(min(n, max(2, np.ceil(min(1.0, frac) * n - 1e-10))))
    trust, fit = np.ones(n), y.copy()
    for _ in range(robust + 1):
        for i in range(n):
            left = min(max(0, i - (k - 1) // 2), n - k)
            at = np.arange(left, left + k)
            far = max(np.abs(x[at] - x[i]).max(), 1e-12)
            w = np.clip(1 - (np.abs(x[at] - x[i]) / far) ** 3, 0, None) ** 3 * trust[at]
            s = w.sum()
            if s <= 0:
                continue
            mx, my = (w * x[at]).sum() / s, (w * y[at]).sum() / s
            var = (w * (x[at] - mx) ** 2).sum()
            slope = (w * (x[at] - mx) * (y[at] - my)).sum() / var if var > 1e-12 * far**2 else 0.0
            fit[i] = my + slope * (x[i] - mx)
        scale = 6 * np.median(np.abs(y - fit))
        if scale <= 0:
            break
        trust = np.clip(1 - ((y - fit) / scale) ** 2, 0, None) ** 2
    return fit


def savgol(y: np.ndarray, window: int, order: int = 2) -> np.ndarray:
    """Least-squares polynomial per window, at its centre; half a window at either edge from the first and last window's fit.

    An even window of bar i spans i - window / 2 + 1 to i + window / 2, its centre is half a bar later.
    """
    y = np.asarray(y, float)
    n = len(y)
    window = int(min(window, n))
    order = min(order, window - 1)
    if window < 1:
        return y.copy()
    centre, half = (window - 1) / 2, window // 2
    solve = np.linalg.pinv(np.vander(np.arange(window) - centre, order + 1, increasing=True))
    out = np.empty(n)
    inner = np.convolve(y, solve[0][::-1], mode="valid")[1 - window % 2 :]
    out[half : n - half] = inner[: n - 2 * half]
    powers = np.arange(order + 1)
    out[:half] = ((np.arange(half)[:, None] - centre) ** powers) @ (solve @ y[:window])
    out[n - half :] = ((np.arange(window - half, window)[:, None] - centre) ** powers) @ (solve @ y[n - window :])
    return out


def turning_points(v: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of maxima and minima: strictly beyond all neighbours up to `order` away; ends never qualify."""

    def tops(x: np.ndarray) -> np.ndarray:
        padded = np.concatenate([np.full(order, -np.inf), x, np.full(order, -np.inf)])
        most = np.lib.stride_tricks.sliding_window_view(padded, order).max(axis=1)
        found = (x > most[: len(x)]) & (x > most[order + 1 : order + 1 + len(x)])
        found[[0, -1]] = False
        return np.flatnonzero(found)

    v = np.asarray(v, float)
    return (tops(v), tops(-v)) if len(v) else (np.zeros(0, int), np.zeros(0, int))


def ema(y: np.ndarray, period: int) -> np.ndarray:
    """Exponential mean that starts as the simple mean of the first `period` values; NaN before."""
    y, out = np.asarray(y, float), np.full(len(y), np.nan)
    start = int(np.argmax(~np.isnan(y))) if (~np.isnan(y)).any() else len(y)
    if len(y) - start < period:
        return out
    at, a = start + period - 1, 2 / (period + 1)
    out[at] = y[start : at + 1].mean()
    for i in range(at + 1, len(y)):
        out[i] = out[i - 1] + a * (y[i] - out[i - 1])
    return out


def macd(y: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MACD line, signal and histogram; the fast mean starts where the slow one does."""
    y = np.asarray(y, float)
    late = np.full(len(y), np.nan)
    late[slow - fast :] = y[slow - fast :]
    line = ema(late, fast) - ema(y, slow)
    s = ema(line, signal)
    return line, s, line - s


def rsi(y: np.ndarray, period: int = 14) -> np.ndarray:
    """Wilder's relative strength index; 0 before its first value, and for a series that never moves."""
    y, out = np.asarray(y, float), np.zeros(len(y))
    if len(y) <= period:
        return out
    d = np.diff(y)
    up, down = np.clip(d, 0, None), np.clip(-d, 0, None)
    u, w = up[:period].mean(), down[:period].mean()
    out[period] = 100 * u / (u + w) if u + w > 0 else 0.0
    for i in range(period, len(d)):
        u, w = (u * (period - 1) + up[i]) / period, (w * (period - 1) + down[i]) / period
        out[i + 1] = 100 * u / (u + w) if u + w > 0 else 0.0
    return out


def simpson(y: np.ndarray) -> float:
    """Simpson's rule at unit steps; of an even number of points the last interval is a trapezium."""
    y = np.asarray(y, float)
    if len(y) < 3:
        return float(y.mean() * (len(y) - 1)) if len(y) else 0.0
    odd = y if len(y) % 2 else y[:-1]
    total = (odd[0] + odd[-1] + 4 * odd[1:-1:2].sum() + 2 * odd[2:-1:2].sum()) / 3
    return float(total if len(y) % 2 else total + (y[-1] + y[-2]) / 2)


def composite(n: int, freq: np.ndarray, phase: np.ndarray, amp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of amp * sin(2 pi f (i - start) + phase) from each component's start on."""
    i = np.arange(n)[:, None] - np.asarray(start)[None, :]
    return (np.where(i >= 0, np.sin(2 * np.pi * np.asarray(freq) * i + np.asarray(phase)), 0.0) * np.asarray(amp)).sum(axis=1)


def algebraic_fit(y: np.ndarray, freq: np.ndarray, start: np.ndarray, least: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Amplitudes and phases of fixed frequencies by linear least squares with an intercept; 0 for a component active in too few rows."""
    y, freq, start = np.asarray(y, float), np.asarray(freq, float), np.asarray(start)
    i = np.arange(len(y))[:, None] - start[None, :]
    used = (i >= 0).sum(axis=0) >= least
    amp, phase = np.zeros(len(freq)), np.zeros(len(freq))
    angle = 2 * np.pi * freq * i
    live = i >= 0
    columns = [np.ones(len(y))]
    for c in np.flatnonzero(used):
        columns += [np.where(live[:, c], np.sin(angle[:, c]), 0), np.where(live[:, c], np.cos(angle[:, c]), 0)]
    w = np.linalg.lstsq(np.column_stack(columns), y, rcond=None)[0]
    a, b = w[1::2], w[2::2]
    amp[used], phase[used] = np.hypot(a, b), np.arctan2(b, a)
    return amp, phase, float(w[0])


def varpro_fit(y: np.ndarray, freq: np.ndarray, start: np.ndarray, steps: int = 25, width: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies within half a bin of their start that lower the residual of algebraic_fit, by damped Gauss-Newton; never worse than the start."""
    y, f0 = np.asarray(y, float), np.asarray(freq, float)
    half = 0.5 / max(1, len(y)) if width is None else width

    def residual(f):
        amp, phase, c = algebraic_fit(y, f, start)
        return y - c - composite(len(y), f, phase, amp, start)

    f, r, damp = f0.copy(), residual(f0), 1e-3
    for _ in range(steps):
        h = 1e-3 * half
        jac = np.column_stack([(residual(f + h * e) - residual(f - h * e)) / (2 * h) for e in np.eye(len(f))])
        g, a = jac.T @ r, jac.T @ jac
        for _ in range(8):
            new = np.clip(f - np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], f0 - half, f0 + half)
            rn = residual(new)
            if rn @ rn < r @ r:
                f, r, damp = new, rn, damp / 3
                break
            damp *= 4
        else:
            break
    amp, phase, _ = algebraic_fit(y, f, start)
    return amp, f, phase


def recent(n: int, freq: np.ndarray, start: np.ndarray, multiplier: float | None) -> np.ndarray:
    """Where each component begins to count: its start, or so many of its periods before the end if that is later."""
    start = np.asarray(start)
    return start if multiplier is None else np.maximum(start, n - (multiplier / np.asarray(freq, float)).astype(int))


def cycle_loss(reference: np.ndarray, amp, freq, phase, start, fitness: str = "mse", tail: int | None = None, multiplier: float | None = None, scaled: bool = True) -> float:
    """Mean squared error of the composite, scaled to [-100, 100] over the tail unless `scaled` is False, against the reference.

    The tail starts where all components are active, or `tail` bars from the end. With a multiplier a component counts
    in its last periods only. `extrema` compares at the composite's turning points only.
    """
    n = len(reference)
    i = np.arange(n)[:, None]
    waves = np.sin(2 * np.pi * np.asarray(freq) * (i - np.asarray(start)) + np.asarray(phase)) * np.asarray(amp)
    c = np.where(i >= recent(n, freq, start, multiplier), waves, 0.0).sum(axis=1)
    begin = min(n - 2, int(np.max(start, initial=0))) if tail is None else max(0, n - tail)
    c, r = c[max(0, begin) :], np.asarray(reference, float)[max(0, begin) :]
    if scaled:
        width = c.max() - c.min()
        c = (c - c.min()) / (width if width > 0 else 1.0) * 200 - 100
    if fitness == "extrema":
        turn = np.flatnonzero((c[1:-1] - c[:-2]) * (c[2:] - c[1:-1]) < 0) + 1
        if len(turn):
            c, r = c[turn], r[turn]
    return float(np.mean((c - r) ** 2))
