"""Queries over the driver's tables, one per operator, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, backtest, calendar, detrend, kernel, optimize, rebuild, score, spectrum, windowing
from ..sources import bars as B
from ..sources import store
from . import analysis
from .config import AnalysisConfig, Band, DetrendConfig, MultiConfig, ProjectionConfig, SpectrumConfig

Query = Callable[[SparkSession, str], DataFrame]
N, LOW, HIGH = 128, 10, 40
GRID, _ = spectrum.grid_size(N, LOW, HIGH)
AS_OF = "2024-01-20 12:00:00"
PI2 = repr(2 * math.pi)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Named subqueries; each may use those before it.
WITH = {
    "bars": """SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx FROM (
        SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
        min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)""",
    "win": f"""SELECT *, bar_idx - last_idx + {N - 1} AS m, last_idx - {N - 1} AS start_idx FROM (SELECT *, max(bar_idx) OVER (PARTITION BY series_id) AS last_idx FROM bars)
        WHERE last_idx >= {N - 1} AND bar_idx > last_idx - {N}""",
    "wx": "SELECT *, close - avg(close) OVER (PARTITION BY series_id) AS x FROM win",
    "grid": f"SELECT k, k / {HIGH * N}.0 AS frequency, {HIGH * N}.0 / k AS period FROM range(1, {GRID + 1}) t(k)",
    "sums": f"SELECT series_id, k, frequency, period, sum(x * cos({PI2} * frequency * m)) AS re, -sum(x * sin({PI2} * frequency * m)) AS im FROM wx, grid GROUP BY ALL",
    "spec": "SELECT series_id, k, frequency, period, 2 * sqrt(re * re + im * im) AS amplitude, pi() / 2 + atan2(im, re) AS phase FROM sums",
    "peaks": """SELECT *, amplitude * frequency AS scaled_amplitude FROM (SELECT *, max(amplitude) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b,
        max(amplitude) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a FROM spec WINDOW w AS (PARTITION BY series_id ORDER BY k)) WHERE amplitude > b AND amplitude > a""",
    "kept": f"SELECT * EXCLUDE (a, b) FROM peaks WHERE period BETWEEN {LOW} AND {HIGH}",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY scaled_amplitude DESC, k) AS rank FROM kept) WHERE rank <= 3",
    "waves": f"""SELECT c.series_id, k AS cycle_id, start_idx + t AS bar_idx, amplitude * sin({PI2} * frequency * t + phase) AS value, amplitude AS weight
        FROM top c JOIN (SELECT DISTINCT series_id, start_idx FROM win) s USING (series_id), range(0, {2 * N}) r(t)""",
    "comp": "SELECT series_id, bar_idx, sum(value) AS composite FROM waves GROUP BY ALL",
    "turns": """SELECT series_id, bar_idx, v AS value, CASE WHEN v > b THEN 1 ELSE -1 END AS kind FROM (SELECT series_id, bar_idx, composite AS v, lag(composite) OVER w AS b, lead(composite) OVER w AS a
        FROM comp WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx)) WHERE (v > b AND v > a) OR (v < b AND v < a)""",
    "asofs": f"SELECT series_id, max(start_idx) + {N - 1} AS as_of_idx FROM win GROUP BY 1",
}


def query(sql: str | None = None, need: str = "") -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            names = list(WITH)
            last = max((names.index(x) for x in need.split()), default=-1)
            parts = [f"{n} AS ({WITH[n]})" for n in names[: last + 1]]
            head, body = ("WITH RECURSIVE ", sql) if "RECURSIVE" in sql else ("WITH ", sql)
            own = body.replace("RECURSIVE ", "", 1)
            if own.lstrip().upper().startswith("WITH "):
                own = own.lstrip()[5:]
                SQL[fn.__name__] = head + ", ".join([*parts, own])
            else:
                SQL[fn.__name__] = (head + ", ".join(parts) + " " if parts else "") + own
        return fn

    return add


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums in another order differ in their last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hourly_events(spark, sf_dir)


def _win(spark, sf_dir) -> DataFrame:
    return windowing.last_bars(_bars(spark, sf_dir), N).withColumn("x", F.col("close") - F.avg("close").over(Window.partitionBy("series_id")))


def _spec(spark, sf_dir) -> DataFrame:
    return spectrum.single_spectrum(_bars(spark, sf_dir), N, LOW, HIGH)


def _kept(spark, sf_dir) -> DataFrame:
    return spectrum.period_filter(spectrum.spectral_peaks(_spec(spark, sf_dir)), LOW, HIGH)


def _cycles(spark, sf_dir) -> DataFrame:
    starts = _win(spark, sf_dir).groupBy("series_id").agg(F.min("start_idx").alias("start_idx"))
    return spectrum.top_cycles(_kept(spark, sf_dir), 3).join(starts, "series_id").withColumn("cycle_id", F.col("k"))


def _as_of(spark, sf_dir) -> DataFrame:
    return _win(spark, sf_dir).groupBy("series_id").agg((F.max("start_idx") + N - 1).alias("as_of_idx"))


def _turns(spark, sf_dir) -> DataFrame:
    return align.turning_points(rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), "composite")


# sources, windows, columns


@query("SELECT series_id, ts, open, high, low, close, volume, bar_idx FROM bars", "bars")
def bars_hourly(spark, sf_dir):
    return _bars(spark, sf_dir).select("series_id", "ts", "open", "high", "low", "close", "volume", "bar_idx")


@query("""SELECT *, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT 'orders' AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open,
    max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)""")
def bars_daily(spark, sf_dir):
    return B.daily_orders(spark, sf_dir).select("series_id", "ts", "open", "high", "low", "close", "volume", "bar_idx")


@query("SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM bars GROUP BY 1", "bars")
def series_span(spark, sf_dir):
    return B.span(_bars(spark, sf_dir))


@query(f"SELECT series_id, bar_idx, close FROM bars WHERE ts <= TIMESTAMP '{AS_OF}'", "bars")
def asof_cut(spark, sf_dir):
    return windowing.as_of_cut(_bars(spark, sf_dir), AS_OF).select("series_id", "bar_idx", "close")


@query(f"""SELECT series_id, bar_idx AS as_of_idx, ts AS as_of_ts FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY (ts = TIMESTAMP '{AS_OF}') DESC, ts DESC) AS r
    FROM bars WHERE ts::DATE = DATE '{AS_OF[:10]}') WHERE r = 1""", "bars")
def asof_bar(spark, sf_dir):
    return windowing.as_of_bar(_bars(spark, sf_dir), AS_OF)


@query("SELECT series_id, bar_idx, m, start_idx, last_idx + 128 AS end_idx, close FROM win", "win")
def tail_n(spark, sf_dir):
    return _win(spark, sf_dir).select("series_id", "bar_idx", "m", "start_idx", "end_idx", "close")


BANDS = "band int, num_samples int, max_period double"


@query("""SELECT series_id, ts, close, row_number() OVER (PARTITION BY series_id ORDER BY bar_idx) - 1 AS bar_idx FROM (SELECT *, max(bar_idx) OVER (PARTITION BY series_id) AS last_idx FROM bars)
    WHERE bar_idx >= last_idx - 240""", "bars")
def protective_cut(spark, sf_dir):
    bands = spark.createDataFrame([(0, 96, 20.0), (1, 160, 40.0)], BANDS)
    return windowing.protective_cut(_bars(spark, sf_dir), bands).select("series_id", "ts", "close", "bar_idx")


@query("SELECT series_id, bar_idx, coalesce(CASE WHEN close < high THEN close END, 0.0) AS close FROM bars", "bars")
def null_fill(spark, sf_dir):
    return windowing.fill_null(_bars(spark, sf_dir).withColumn("close", F.when(F.col("close") < F.col("high"), F.col("close"))), "close").select("series_id", "bar_idx", "close")


@query("""SELECT series_id, bar_idx, round(close - open, 6) AS co, round(high - low, 6) AS hl, round(close - low, 6) AS cl, round(close - high, 6) AS ch, round(high - open, 6) AS ho, round(open - low, 6) AS ol,
    round((high - low) / nullif(volume, 0), 6) AS hl_volume, round((close - lag(close) OVER w) / nullif(volume - lag(volume) OVER w, 0), 6) AS dclose_dvolume, round(coalesce(open - lag(open) OVER w, 0), 6) AS dopen,
    round(coalesce(high - lag(high) OVER w, 0), 6) AS dhigh, round(coalesce(low - lag(low) OVER w, 0), 6) AS dlow, round(coalesce(close - lag(close) OVER w, 0), 6) AS dclose, round(coalesce(volume - lag(volume) OVER w, 0), 6) AS dvolume
    FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx)""", "bars")
def bar_features(spark, sf_dir):
    return _r(windowing.bar_features(_bars(spark, sf_dir)))


@query("SELECT series_id, bar_idx, round(coalesce(close - lag(close) OVER (PARTITION BY series_id ORDER BY bar_idx), 0), 6) AS diff FROM bars", "bars")
def diff(spark, sf_dir):
    return _r(windowing.difference(_bars(spark, sf_dir), "close").select("series_id", "bar_idx", "diff"))


@query("SELECT series_id, bar_idx, round((close - avg(close) OVER w) / stddev_pop(close) OVER w, 6) AS z FROM bars WINDOW w AS (PARTITION BY series_id)", "bars")
def zscore(spark, sf_dir):
    return _r(windowing.zscore(_bars(spark, sf_dir), "close").select("series_id", "bar_idx", "z"))


@query("SELECT series_id, bar_idx, round((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) * 2 - 1, 6) AS scaled FROM bars WINDOW w AS (PARTITION BY series_id)", "bars")
def minmax_scale(spark, sf_dir):
    return _r(windowing.minmax(_bars(spark, sf_dir), "close").select("series_id", "bar_idx", "scaled"))


@query("""SELECT series_id, bar_idx, round(CASE WHEN count(close) OVER s = 10 THEN avg(close) OVER s END - CASE WHEN count(close) OVER l = 21 THEN avg(close) OVER l END, 6) AS delta FROM bars
    WINDOW s AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), l AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""", "bars")
def centered_mean_delta(spark, sf_dir):
    return _r(windowing.centered_delta(_bars(spark, sf_dir), "close", 21).select("series_id", "bar_idx", "delta"))


@query("""SELECT band, min_period, max_period, hp_lambda, round(coalesce((SELECT min(o.hp_lambda) FROM b o WHERE o.max_period = b.min_period), 1 / (16 * sin(pi() / greatest(2, floor(min_period)))^4)), 6) AS lambda_min
    FROM (VALUES (0, 10.0::DOUBLE, 30.0::DOUBLE, 1600.0::DOUBLE), (1, 30.0, 60.0, 6400.0), (2, 60.0, 90.0, 20000.0)) b(band, min_period, max_period, hp_lambda)""".replace("FROM b o", "FROM (VALUES (30.0::DOUBLE, 1600.0::DOUBLE), (60.0, 6400.0), (90.0, 20000.0)) o(max_period, hp_lambda)"))
def band_self_join(spark, sf_dir):
    bands = spark.createDataFrame([(0, 10.0, 30.0, 1600.0), (1, 30.0, 60.0, 6400.0), (2, 60.0, 90.0, 20000.0)], "band int, min_period double, max_period double, hp_lambda double")
    return _r(windowing.band_lambdas(bands)).select("band", "min_period", "max_period", "hp_lambda", "lambda_min")


# detrending


@query("""WITH b AS (SELECT *, (bar_idx - skipped) // 64 AS block FROM (SELECT *, count(*) OVER (PARTITION BY series_id) % 64 AS skipped FROM bars) WHERE bar_idx >= skipped)
    SELECT series_id, bar_idx, block, round(close - (regr_intercept(close, bar_idx) OVER w + regr_slope(close, bar_idx) OVER w * bar_idx), 9) AS detrended FROM b WINDOW w AS (PARTITION BY series_id, block)""", "bars")
def linear_detrend_blocks(spark, sf_dir):
    return _r(detrend.linear_blocks(_bars(spark, sf_dir), "close", 64), 9)


@query("""WITH c AS (SELECT series_id, bar_idx, close AS y, bar_idx - avg(bar_idx) OVER (PARTITION BY series_id) AS x FROM bars),
    s AS (SELECT series_id, count(*) AS n, sum(x * x) AS s2, sum(x * x * x * x) AS s4, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x * y) AS sxxy FROM c GROUP BY 1)
    SELECT series_id, bar_idx, round(y - ((s4 * sy - s2 * sxxy) / (n * s4 - s2 * s2) + sxy / s2 * x + (n * sxxy - s2 * sy) / (n * s4 - s2 * s2) * x * x), 6) AS detrended FROM c JOIN s USING (series_id)""", "bars")
def quadratic_detrend(spark, sf_dir):
    return _r(detrend.quadratic(_bars(spark, sf_dir), "close"))


def _hp_sql(lam: float, out: str) -> str:
    """The pentadiagonal elimination as a recursive query: forward over bars, then back."""
    return f"""{out}f AS (SELECT series_id, bar_idx AS i, n, {1 + lam}::DOUBLE AS p, 0::DOUBLE AS p1, 0::DOUBLE AS l1, 0::DOUBLE AS l1p, 0::DOUBLE AS l2, y AS z, 0::DOUBLE AS z1 FROM src WHERE bar_idx = 0
      UNION ALL SELECT s.series_id, s.bar_idx, s.n, d - b * b * f.p - a * a * f.p1, f.p, b, f.l1, a, s.y - b * f.z - a * f.z1, f.z
      FROM (SELECT f.*, CASE WHEN f.i >= 1 THEN {lam} / f.p1 ELSE 0 END AS a, (CASE WHEN f.i = 0 OR f.i = n - 2 THEN {-2 * lam} ELSE {-4 * lam} END - CASE WHEN f.i >= 1 THEN {lam} * f.l1 ELSE 0 END) / f.p AS b,
        CASE WHEN f.i + 1 = 1 OR f.i + 1 = n - 2 THEN {1 + 5 * lam} WHEN f.i + 1 = n - 1 THEN {1 + lam} ELSE {1 + 6 * lam} END AS d FROM {out}f f) f JOIN src s ON s.series_id = f.series_id AND s.bar_idx = f.i + 1),
    {out}l AS (SELECT series_id, i, n, z / p AS q, lead(l1) OVER w AS n1, lead(l2, 2) OVER w AS n2 FROM {out}f WINDOW w AS (PARTITION BY series_id ORDER BY i)),
    {out}r AS (SELECT series_id, i, q AS t, 0::DOUBLE AS t1 FROM {out}l WHERE i = n - 1
      UNION ALL SELECT l.series_id, l.i, l.q - l.n1 * r.t - coalesce(l.n2, 0) * r.t1, r.t FROM {out}r r JOIN {out}l l ON l.series_id = r.series_id AND l.i = r.i - 1)"""


SRC = "src AS (SELECT series_id, bar_idx, close AS y, count(*) OVER (PARTITION BY series_id) AS n FROM bars)"


@query(f"RECURSIVE WITH {SRC}, {_hp_sql(1600.0, 'a')} SELECT s.series_id, bar_idx, round(y - t, 6) AS detrended FROM src s JOIN ar a ON a.series_id = s.series_id AND a.i = s.bar_idx", "bars")
def hp_filter(spark, sf_dir):
    return _r(kernel.hp_filter(_bars(spark, sf_dir), "close", 1600.0))


@query(f"RECURSIVE WITH {SRC}, {_hp_sql(1600.0, 'a')}, {_hp_sql(20.0, 'b')} SELECT s.series_id, bar_idx, round(b.t - a.t, 6) AS detrended FROM src s JOIN ar a ON a.series_id = s.series_id AND a.i = s.bar_idx JOIN br b ON b.series_id = s.series_id AND b.i = s.bar_idx", "bars")
def band_pass(spark, sf_dir):
    return _r(kernel.band_pass(_bars(spark, sf_dir), "close", 1600.0, 20.0))


def _residual_sql(columns: int) -> str:
    """Gram-Schmidt over x0 .. x(columns - 1) of src (series_id, bar_idx, y, x..): the last step's y is the least-squares residual."""
    parts, names = [], [f"x{j}" for j in range(columns)] + ["y"]
    for j in range(columns):
        dot = lambda a: f"sum({a} * x{j}) OVER (PARTITION BY series_id) / nullif(sum(x{j} * x{j}) OVER (PARTITION BY series_id), 0)"  # noqa: B023, E731
        parts.append(f"g{j + 1} AS (SELECT series_id, bar_idx, {', '.join(f'{a} - coalesce({dot(a)}, 0) * x{j} AS {a}' for a in names[j + 1 :])} FROM g{j})")
    return ", ".join(parts)


JH = """g0 AS (SELECT series_id, bar_idx, 1.0::DOUBLE AS x0, lag(close, 8) OVER w AS x1, lag(close, 9) OVER w AS x2, lag(close, 10) OVER w AS x3, lag(close, 11) OVER w AS x4, close AS y FROM bars
    WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx) QUALIFY bar_idx >= 11)"""


@query(f"WITH {JH}, {_residual_sql(5)} SELECT b.series_id, b.bar_idx, round(g.y, 6) AS detrended FROM bars b LEFT JOIN g5 g ON g.series_id = b.series_id AND g.bar_idx = b.bar_idx", "bars")
def jh_filter(spark, sf_dir):
    return _r(kernel.jh_filter(_bars(spark, sf_dir), "close", 8, 4))


@query()
def lowess(spark, sf_dir):
    return _r(kernel.lowess_filter(_bars(spark, sf_dir), "close", 4, HIGH))


#: A parabola by least squares over w bars: the weight of the bar that lies d from the window's centre, at e from the centre; sums of d**2 and d**4 in closed form.
S2, S4 = "(w * (w * w - 1) / 12.0)", "(w * (w * w - 1) * (3 * w * w - 7) / 240.0)"
WEIGHT = f"(({S4} - {S2} * d * d) / (w * {S4} - {S2} * {S2}) + e * d / {S2} + e * e * (w * d * d - {S2}) / (w * {S4} - {S2} * {S2}))"


def _parabolas_sql(src: str, keys: str, i: str, y: str, window: str) -> str:
    """SELECT keys, i, w and smoothed y of src, which has the window length, the number of bars n and the keys; edges follow the first and the last window."""
    at = f"""SELECT {keys}, {i} AS i, {window} AS w, CASE WHEN {i} < {window} // 2 THEN 0 WHEN {i} >= n - {window} // 2 THEN n - {window} ELSE {i} - {window} // 2 + 1 - {window} % 2 END AS s,
        CASE WHEN {i} < {window} // 2 THEN {i} - ({window} - 1) / 2.0 WHEN {i} >= n - {window} // 2 THEN {i} - (n - {window}) - ({window} - 1) / 2.0 ELSE 0 END AS e FROM {src}"""
    same = " AND ".join(f"v.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {keys}, i, w, sum(y * {WEIGHT}) AS smoothed FROM (SELECT {', '.join(f'p.{k.strip()}' for k in keys.split(','))}, p.i, p.w::DOUBLE AS w, p.e, v.{y} AS y, v.{i} - p.s - (p.w - 1) / 2.0 AS d
        FROM ({at}) p JOIN {src} v ON {same} AND v.{i} BETWEEN p.s AND p.s + p.w - 1) GROUP BY ALL"""


COUNTED = "nb AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM bars)"


@query(f"WITH {COUNTED} SELECT series_id, i AS bar_idx, round(smoothed, 6) AS smoothed FROM ({_parabolas_sql('nb', 'series_id', 'bar_idx', 'close', '11')})", "bars")
def savgol(spark, sf_dir):
    return _r(kernel.savgol(_bars(spark, sf_dir), "close", 11))


@query(f"WITH {COUNTED} SELECT series_id, i AS bar_idx, round(smoothed, 6) AS smoothed FROM ({_parabolas_sql('nb', 'series_id', 'bar_idx', 'close', '30')})", "bars")
def savgol_even(spark, sf_dir):
    return _r(kernel.savgol(_bars(spark, sf_dir), "close", 30))


EMA = "SELECT series_id, bar_idx AS i, avg(y) OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS e FROM {src}"


@query("""RECURSIVE WITH fast AS (SELECT series_id, 25::BIGINT AS i, avg(close) FILTER (WHERE bar_idx BETWEEN 14 AND 25) AS e FROM bars GROUP BY 1 HAVING count(*) > 25
      UNION ALL SELECT b.series_id, b.bar_idx, e + 2 / 13.0 * (close - e) FROM fast f JOIN bars b ON b.series_id = f.series_id AND b.bar_idx = f.i + 1),
    slow AS (SELECT series_id, 25::BIGINT AS i, avg(close) FILTER (WHERE bar_idx <= 25) AS e FROM bars GROUP BY 1 HAVING count(*) > 25
      UNION ALL SELECT b.series_id, b.bar_idx, e + 2 / 27.0 * (close - e) FROM slow f JOIN bars b ON b.series_id = f.series_id AND b.bar_idx = f.i + 1),
    line AS (SELECT series_id, i, f.e - s.e AS y FROM fast f JOIN slow s USING (series_id, i)),
    sig AS (SELECT series_id, 33::BIGINT AS i, avg(y) FILTER (WHERE i <= 33) AS e FROM line GROUP BY 1 HAVING count(*) > 8
      UNION ALL SELECT b.series_id, b.i, e + 2 / 10.0 * (y - e) FROM sig f JOIN line b ON b.series_id = f.series_id AND b.i = f.i + 1)
    SELECT b.series_id, bar_idx, round(y, 6) AS macd, round(e, 6) AS signal, round(y - e, 6) AS histogram FROM bars b LEFT JOIN line l ON l.series_id = b.series_id AND l.i = b.bar_idx LEFT JOIN sig s ON s.series_id = b.series_id AND s.i = b.bar_idx""", "bars")
def macd(spark, sf_dir):
    return _r(kernel.macd(_bars(spark, sf_dir), "close"))


@query("""RECURSIVE WITH d AS (SELECT series_id, bar_idx, greatest(close - lag(close) OVER w, 0) AS u, greatest(lag(close) OVER w - close, 0) AS v FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx)),
    s AS (SELECT series_id, 14::BIGINT AS i, avg(u) FILTER (WHERE bar_idx BETWEEN 1 AND 14) AS a, avg(v) FILTER (WHERE bar_idx BETWEEN 1 AND 14) AS b FROM d GROUP BY 1 HAVING count(*) > 14
      UNION ALL SELECT d.series_id, d.bar_idx, (a * 13 + u) / 14, (b * 13 + v) / 14 FROM s JOIN d ON d.series_id = s.series_id AND d.bar_idx = s.i + 1),
    r AS (SELECT b.series_id, bar_idx, coalesce(100 * s.a / nullif(s.a + s.b, 0), 0) AS rsi FROM bars b LEFT JOIN s ON s.series_id = b.series_id AND s.i = b.bar_idx)
    SELECT series_id, bar_idx, round(rsi, 6) AS rsi, round(coalesce(rsi - lag(rsi) OVER (PARTITION BY series_id ORDER BY bar_idx), 0), 6) AS rsi_diff FROM r""", "bars")
def rsi(spark, sf_dir):
    return _r(kernel.rsi(_bars(spark, sf_dir), "close"))


@query()
def smoothed_indicators(spark, sf_dir):
    """MACD and RSI of Savitzky-Golay smoothed series."""
    b = _bars(spark, sf_dir)
    return _r(kernel.macd(b, "close", smooth=11).join(kernel.rsi(b, "close", smooth=11), ["series_id", "bar_idx"]))


# spectrum and peaks


@query(f"SELECT k, round(frequency, 12) AS frequency, round(period, 9) AS period FROM grid", "grid")
def freq_grid(spark, sf_dir):
    return spectrum.frequency_grid(spark, N, LOW, HIGH).select("k", F.round("frequency", 12).alias("frequency"), F.round("period", 9).alias("period"))


#: The modified Bessel function of order 0 by its power series.
BESSEL = "(SELECT sum(CASE WHEN j = 0 THEN 1 WHEN {0} <= 0 THEN 0 ELSE exp(2 * j * ln({0} / 2) - 2 * lgamma(j + 1)) END) FROM range(0, 60) s(j))"


@query(f"SELECT m, round({BESSEL.format(f'(8 * sqrt(greatest(0, 1 - (2.0::DOUBLE * m / {N - 1} - 1) ** 2)))')} / {BESSEL.format('8.0::DOUBLE')}, 9) AS weight FROM range(0, {N}) t(m)")
def kaiser_window(spark, sf_dir):
    rows = spark.range(N).select(F.col("id").alias("m"), F.lit(1.0).alias("one"))
    return spectrum.tapered(rows, "one", N, 8.0).select("m", F.round("tapered", 9).alias("weight"))


@query("SELECT series_id, k, round(frequency, 12) AS frequency, round(period, 6) AS period, round(amplitude, 6) AS amplitude, round(phase, 5) AS phase FROM spec", "spec")
def goertzel_spectrum(spark, sf_dir):
    return _spec(spark, sf_dir).select("series_id", "k", F.round("frequency", 12).alias("frequency"), F.round("period", 6).alias("period"), F.round("amplitude", 6).alias("amplitude"), F.round("phase", 5).alias("phase"))


@query("SELECT series_id, k, round(amplitude, 6) AS amplitude FROM spec", "spec")
def goertzel_matrix(spark, sf_dir):
    """The same spectrum by one matrix product per batch of series."""
    return spectrum.spectrum_kernel(_win(spark, sf_dir), N, LOW, HIGH, "x").select("series_id", "k", F.round("amplitude", 6).alias("amplitude"))


MOD = "(({0}) - {1} * floor(({0}) / {1}))"


@query(f"""WITH a AS (SELECT *, {PI2} * frequency * ({N} - period * floor({N} / period)) + phase AS arg FROM top), b AS (SELECT *, {MOD.format('arg', PI2)} AS pos FROM a)
    SELECT series_id, k, round({MOD.format('1.5 * pi() - pos', PI2)} / ({PI2} * frequency), 5) AS min_offset, round({MOD.format('0.5 * pi() - pos', PI2)} / ({PI2} * frequency), 5) AS max_offset FROM b""", "top")
def goertzel_offsets(spark, sf_dir):
    return _r(spectrum.offsets(spectrum.top_cycles(_kept(spark, sf_dir), 3), N).select("series_id", "k", "min_offset", "max_offset"), 5)


@query("SELECT series_id, k, round(period, 6) AS period, round(amplitude, 6) AS amplitude, round(scaled_amplitude, 6) AS scaled_amplitude FROM peaks", "peaks")
def spectrum_peaks(spark, sf_dir):
    return _r(spectrum.spectral_peaks(_spec(spark, sf_dir)).select("series_id", "k", "period", "amplitude", "scaled_amplitude"))


@query("SELECT series_id, k, round(period, 6) AS period FROM kept", "kept")
def period_filter(spark, sf_dir):
    return _r(_kept(spark, sf_dir).select("series_id", "k", "period"))


@query("SELECT series_id, k FROM (SELECT series_id, k, row_number() OVER (PARTITION BY series_id ORDER BY k) AS n FROM peaks) WHERE n <= 5", "peaks")
def first_harmonics(spark, sf_dir):
    return spectrum.period_filter(spectrum.spectral_peaks(_spec(spark, sf_dir)), LOW, HIGH, first=5).select("series_id", "k")


@query(f"""WITH j AS (SELECT w.series_id, k, m // floor(period)::BIGINT AS segment, close * sin({PI2} * (m + 1) / period) AS a, close * cos({PI2} * (m + 1) / period) AS b FROM win w JOIN kept p USING (series_id)
      WHERE m // floor(period)::BIGINT < least({N} // floor(period)::BIGINT, 30)),
    s AS (SELECT series_id, k, segment, sum(a) AS a, sum(b) AS b FROM j GROUP BY ALL),
    e AS (SELECT series_id, k, sqrt(avg(a) ** 2 + avg(b) ** 2) / (sqrt(avg(a * a + b * b)) / sqrt(count(*))) AS b1 FROM s GROUP BY ALL)
    SELECT series_id, k, round(exp(-b1 * b1), 6) AS bartels_score, round(1 - exp(-b1 * b1), 6) AS significance FROM e""", "kept")
def bartels_score(spark, sf_dir):
    return _r(spectrum.bartels(_win(spark, sf_dir), _kept(spark, sf_dir), "close").select("series_id", "k", "bartels_score", "significance"))


@query("""SELECT series_id, k, (rank() OVER (PARTITION BY series_id ORDER BY round(scaled_amplitude, 1)) + (count(*) OVER (PARTITION BY series_id, round(scaled_amplitude, 1)) - 1) / 2.0
      + rank() OVER (PARTITION BY series_id ORDER BY floor(period / 5) DESC) + (count(*) OVER (PARTITION BY series_id, floor(period / 5)) - 1) / 2.0)::DOUBLE AS global_score FROM kept""", "kept")
def avg_rank_score(spark, sf_dir):
    rows = _kept(spark, sf_dir).select("series_id", "k", F.round("scaled_amplitude", 1).alias("a"), F.floor(F.col("period") / 5).alias("b"))
    return score.global_score(rows, ["a", "absent"], ["b"]).select("series_id", "k", "global_score")


@query("SELECT series_id, k, round(period, 6) AS period, round(scaled_amplitude, 6) AS scaled_amplitude, rank FROM top", "top")
def topk_cycles(spark, sf_dir):
    return _r(spectrum.top_cycles(_kept(spark, sf_dir), 3).select("series_id", "k", "period", "scaled_amplitude", F.col("rank").cast("long").alias("rank")))


@query("SELECT series_id, max(period) AS dominant_period FROM (SELECT series_id, round(period, 6) AS period FROM top) GROUP BY 1", "top")
def dominant_period(spark, sf_dir):
    return _r(score.dominant(_kept(spark, sf_dir), 3, "scaled_amplitude").select("series_id", "dominant_period").distinct())


@query("""SELECT series_id, bar_idx, close > b1 AND close > a1 AS is_max, close < b2 AND close < a2 AS is_min FROM (SELECT series_id, bar_idx, close,
    max(close) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b1, max(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a1, min(close) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b2,
    min(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a2 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx)) WHERE (close > b1 AND close > a1) OR (close < b2 AND close < a2)""", "bars")
def local_extrema(spark, sf_dir):
    return spectrum.local_extrema(_bars(spark, sf_dir), "close", 10, ["series_id"], "bar_idx").where("is_max OR is_min").select("series_id", "bar_idx", "is_max", "is_min")


#: Scores of every candidate against two smoothed means, from sums and joins alone.
SCORES = f"""WITH pk AS (SELECT series_id, k, period, frequency, phase, floor(period)::BIGINT AS w1, floor(2 * period)::BIGINT AS w2, greatest(1, floor(period / 2))::BIGINT AS turn FROM kept),
    px AS (SELECT p.*, m, x, {N} AS n FROM pk p JOIN wx USING (series_id)),
    l AS ({_parabolas_sql('px', 'series_id, k', 'm', 'x', 'w2')}), s AS ({_parabolas_sql('px', 'series_id, k', 'm', 'x', 'w1')}),
    raw AS (SELECT p.series_id, p.k, period, turn, p.m, sin({PI2} * frequency * (p.m * {N} / {N - 1}.0) + phase) AS a, s.smoothed - l.smoothed AS b FROM px p JOIN s ON s.series_id = p.series_id AND s.k = p.k AND s.i = p.m JOIN l ON l.series_id = p.series_id AND l.k = p.k AND l.i = p.m),
    z AS (SELECT * REPLACE ((a - avg(a) OVER g) / stddev_pop(a) OVER g AS a, (b - avg(b) OVER g) / stddev_pop(b) OVER g AS b) FROM raw WINDOW g AS (PARTITION BY series_id, k)),
    c AS (SELECT *, coalesce(a - lag(a) OVER g, 0) AS da, coalesce(b - lag(b) OVER g, 0) AS db,
      CASE WHEN m >= {N - 1} THEN 0 WHEN m = 0 OR m = {N - 2} THEN 1 / 3.0::DOUBLE WHEN m % 2 = 1 THEN 4 / 3.0::DOUBLE ELSE 2 / 3.0::DOUBLE END + CASE WHEN m >= {N - 2} THEN 0.5 ELSE 0 END AS u FROM z WINDOW g AS (PARTITION BY series_id, k ORDER BY m)),
    o AS (SELECT series_id, k, period, sum(a * b * u) AS corr, sum(da * db * u) AS slope FROM c GROUP BY ALL),
    v AS (SELECT series_id, k, turn, 'a' AS sig, m, a AS v FROM z UNION ALL SELECT series_id, k, turn, 'b', m, b FROM z),
    e AS (SELECT p.series_id, p.k, p.sig, p.m, p.v > max(q.v) FILTER (q.m < p.m) AND p.v > max(q.v) FILTER (q.m > p.m) AS top, p.v < min(q.v) FILTER (q.m < p.m) AND p.v < min(q.v) FILTER (q.m > p.m) AS low
      FROM v p JOIN v q ON q.series_id = p.series_id AND q.k = p.k AND q.sig = p.sig AND q.m BETWEEN p.m - p.turn AND p.m + p.turn AND q.m <> p.m GROUP BY p.series_id, p.k, p.sig, p.m, p.v),
    t AS (SELECT series_id, k, sig, m, CASE WHEN top THEN 1 ELSE -1 END AS kind FROM e WHERE top OR low),
    n AS (SELECT series_id, k, kind, count(*) FILTER (sig = 'a') AS na, count(*) FILTER (sig = 'b') AS nb FROM t GROUP BY ALL),
    d AS (SELECT r.series_id, r.k, r.kind, r.m, min(abs(r.m - f.m)) AS gap FROM t r JOIN n USING (series_id, k, kind) JOIN t f ON f.series_id = r.series_id AND f.k = r.k AND f.kind = r.kind AND f.sig <> r.sig WHERE r.sig = CASE WHEN nb >= na THEN 'b' ELSE 'a' END GROUP BY ALL),
    f AS (SELECT series_id, k, sqrt(avg(gap * gap)) AS rmse FROM d GROUP BY ALL), h AS (SELECT series_id, k, sum(na) AS na, sum(nb) AS nb FROM n GROUP BY ALL)
    SELECT o.series_id, o.k, round(corr, 4) AS savgol_corr, round(slope / nullif(coalesce(na, 0), 0), 5) AS derivative_corr, round(coalesce(rmse / period, 1), 6) AS phase_rmse, round(abs(coalesce(na, 0) - coalesce(nb, 0)) / period, 6) AS peak_ratio
    FROM o LEFT JOIN f USING (series_id, k) LEFT JOIN h USING (series_id, k)"""


@query(SCORES, "kept")
def cycle_scores(spark, sf_dir):
    found = score.scored(_win(spark, sf_dir), _kept(spark, sf_dir))
    return found.select("series_id", "k", F.round("savgol_corr", 4).alias("savgol_corr"), F.round("derivative_corr", 5).alias("derivative_corr"), F.round("phase_rmse", 6).alias("phase_rmse"), F.round("peak_ratio", 6).alias("peak_ratio"))


LAMBDA_10 = float(1 / (16 * math.sin(math.pi / 10) ** 4))


@query(f"""RECURSIVE WITH {SRC}, {_hp_sql(1600.0, 'a')}, {_hp_sql(LAMBDA_10, 'b')}, {_hp_sql(6400.0, 'c')} SELECT s.series_id, bar_idx, round(y - a.t, 6) AS without, round(b.t - a.t, 6) AS fastest, round(a.t - c.t, 6) AS neighbour
    FROM src s JOIN ar a ON a.series_id = s.series_id AND a.i = s.bar_idx JOIN br b ON b.series_id = s.series_id AND b.i = s.bar_idx JOIN cr c ON c.series_id = s.series_id AND c.i = s.bar_idx""", "bars")
def band_pass_default(spark, sf_dir):
    """Without a fast cutoff nothing is taken off; of several bands the fastest has one from its shortest period, others their neighbour's lambda."""
    b = _bars(spark, sf_dir)
    known = spark.createDataFrame([(0, 10.0, 30.0, 1600.0), (1, 30.0, 60.0, 6400.0)], "band int, min_period double, max_period double, hp_lambda double")
    fast = {r["band"]: r["lambda_min"] for r in windowing.band_lambdas(known).collect()}
    one = lambda lam, low, name: analysis.detrended(b, "close", DetrendConfig("band_pass", lam, low), 60).withColumnRenamed("detrended", name)
    out = one(1600.0, None, "without").join(one(1600.0, fast[0], "fastest"), ["series_id", "bar_idx"]).join(one(6400.0, fast[1], "neighbour"), ["series_id", "bar_idx"])
    return _r(out)


# cycles over time


@query("SELECT series_id, cycle_id, bar_idx, round(value, 5) AS value FROM waves", "waves")
def sinusoid_rebuild(spark, sf_dir):
    return _r(rebuild.sinusoids(_cycles(spark, sf_dir), N), 5)


@query("SELECT series_id, bar_idx, round(composite, 5) AS composite FROM comp", "comp")
def composite(spark, sf_dir):
    return _r(rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), 5)


@query("SELECT series_id, bar_idx, round(coalesce(composite, 0), 5) AS composite, b.close IS NULL AS is_projected FROM bars b FULL JOIN comp c USING (series_id, bar_idx)", "comp")
def align_padded(spark, sf_dir):
    return _r(rebuild.aligned(_bars(spark, sf_dir), rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), "composite"), 5)


@query("""WITH l AS (SELECT t.*, bar_idx - as_of_idx AS idx_delta, bar_idx >= as_of_idx AS late FROM turns t JOIN asofs USING (series_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY series_id, late ORDER BY abs(idx_delta)) AS n FROM l), k AS (SELECT *, CASE WHEN late THEN n ELSE -n END AS label FROM r WHERE n <= 3)
    SELECT series_id, label, idx_delta, kind, round(value, 5) AS value, round(abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY bar_idx)), 5) AS contiguous_delta FROM k""", "asofs")
def minmax_labels(spark, sf_dir):
    return _r(align.labelled(_turns(spark, sf_dir), _as_of(spark, sf_dir), 3).withColumn("label", F.col("label").cast("long")), 5)


@query("""SELECT series_id, CASE WHEN kind = -1 THEN 1 ELSE -1 END AS trend FROM (SELECT t.series_id, kind, row_number() OVER (PARTITION BY t.series_id ORDER BY bar_idx DESC) AS n
    FROM turns t JOIN asofs a ON a.series_id = t.series_id AND bar_idx < as_of_idx) WHERE n = 1""", "asofs")
def cycle_trend(spark, sf_dir):
    return align.trend(align.labelled(_turns(spark, sf_dir), _as_of(spark, sf_dir), 3))


KPI = """WITH g AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM waves WINDOW w AS (PARTITION BY series_id, cycle_id ORDER BY bar_idx)),
    e AS (SELECT *, CASE WHEN (value > b AND value > a) THEN 1 WHEN (value < b AND value < a) THEN -1 END AS kind FROM g),
    n AS (SELECT *, last_value(CASE WHEN kind IS NOT NULL THEN bar_idx END IGNORE NULLS) OVER p AS pi, last_value(kind IGNORE NULLS) OVER p AS pk, first_value(CASE WHEN kind IS NOT NULL THEN bar_idx END IGNORE NULLS) OVER f AS fi FROM e
      WINDOW p AS (PARTITION BY series_id, cycle_id ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY series_id, cycle_id ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    h AS (SELECT *, coalesce((fi - bar_idx)::DOUBLE / (fi - pi) * pk, 0) AS share FROM n)"""


@query(KPI + " SELECT series_id, bar_idx, round(sum(share), 6) AS alignment FROM h GROUP BY ALL", "waves")
def alignment_kpi(spark, sf_dir):
    return _r(align.alignment(rebuild.sinusoids(_cycles(spark, sf_dir), N)))


@query(KPI + ", t AS (SELECT series_id, sum(amplitude) AS total FROM top GROUP BY 1) SELECT series_id, bar_idx, round(sum(share * weight / total), 6) AS alignment FROM h JOIN t USING (series_id) GROUP BY ALL", "waves")
def weighted_alignment(spark, sf_dir):
    c = _cycles(spark, sf_dir)
    return _r(align.alignment(rebuild.sinusoids(c, N), c.select("series_id", "cycle_id", F.col("amplitude").alias("weight"))))


NEAR = """WITH s AS (SELECT series_id, bar_idx AS pos FROM turns WHERE kind = 1), d AS (SELECT series_id, bar_idx AS pos FROM turns WHERE kind = -1),
    j AS (SELECT d.series_id, d.pos, min(abs(d.pos - s.pos)) AS distance FROM d JOIN s USING (series_id) GROUP BY ALL)"""


@query(NEAR + " SELECT series_id, round(sqrt(avg(distance * distance)) / 20, 6) AS phase_rmse FROM j GROUP BY 1", "turns")
def nearest_peak_rmse(spark, sf_dir):
    t = _turns(spark, sf_dir).select("series_id", F.col("bar_idx").alias("pos"), "kind")
    return _r(score.peak_rmse(score.nearest_peaks(t.where("kind = -1").drop("kind"), t.where("kind = 1").drop("kind")), 20))


@query("""WITH x AS (SELECT series_id, close, bar_idx AS i, count(*) OVER (PARTITION BY series_id) AS n FROM bars), y AS (SELECT *, n - (1 - n % 2) AS o FROM x)
    SELECT series_id, round(sum(close * (CASE WHEN i >= o THEN 0 WHEN i = 0 OR i = o - 1 THEN 1 / 3.0::DOUBLE WHEN i % 2 = 1 THEN 4 / 3.0::DOUBLE ELSE 2 / 3.0::DOUBLE END + CASE WHEN n % 2 = 0 AND i >= n - 2 THEN 0.5 ELSE 0 END)), 4) AS integral FROM y GROUP BY 1""", "bars")
def simpson(spark, sf_dir):
    return _r(score.simpson(_bars(spark, sf_dir), "close"), 4)


@query("SELECT series_id, round(avg((composite - x) ** 2), 4) AS mse FROM wx JOIN comp USING (series_id, bar_idx) WHERE bar_idx >= 500 GROUP BY 1", "comp")
def mse_tail(spark, sf_dir):
    rows = _win(spark, sf_dir).join(rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), ["series_id", "bar_idx"])
    return _r(rebuild.tail_mse(rows, "composite", "x", 500), 4)


@query("SELECT series_id, round(corr(composite, x), 4) AS correlation, round(avg((composite - x) ** 2) / var_pop(x), 4) AS nmse FROM wx JOIN comp USING (series_id, bar_idx) GROUP BY 1", "comp")
def fit_fidelity(spark, sf_dir):
    rows = _win(spark, sf_dir).join(rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), ["series_id", "bar_idx"])
    return rebuild.fidelity(rows, "composite", "x")


@query("""WITH j AS (SELECT w.series_id, bar_idx, composite, x, last_idx FROM wx w JOIN comp USING (series_id, bar_idx)),
    f AS (SELECT series_id, regr_slope(x, composite) AS b, regr_intercept(x, composite) AS a FROM j WHERE bar_idx > last_idx - 64 GROUP BY 1) SELECT series_id, bar_idx, round(a + b * composite, 5) AS fitted FROM j JOIN f USING (series_id)""", "comp")
def scale_lsq(spark, sf_dir):
    rows = _win(spark, sf_dir).select("series_id", "bar_idx", "x").join(rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), ["series_id", "bar_idx"])
    return _r(rebuild.scaled_to(rows, "composite", "x", 64).select("series_id", "bar_idx", "fitted"), 5)


@query(f"""WITH c AS (SELECT series_id, k, frequency, start_idx + 32 AS s FROM top JOIN (SELECT DISTINCT series_id, start_idx FROM win) USING (series_id)),
    t AS (SELECT series_id, k, sum(x * cos({PI2} * frequency * (bar_idx - s))) AS re, -sum(x * sin({PI2} * frequency * (bar_idx - s))) AS im FROM wx JOIN c USING (series_id) WHERE bar_idx >= s GROUP BY ALL)
    SELECT series_id, k AS cycle_id, round(2 * sqrt(re * re + im * im), 5) AS amplitude, round(pi() / 2 + atan2(im, re), 5) AS phase FROM t""", "top")
def reestimated_cycles(spark, sf_dir):
    reference = _win(spark, sf_dir).select("series_id", "bar_idx", F.col("x").alias("value"))
    cycles = _cycles(spark, sf_dir).withColumn("start_idx", F.col("start_idx") + 32)
    return _r(rebuild.reestimated(reference, cycles).select("series_id", "cycle_id", "amplitude", "phase"), 5)


# calendar


@query("""SELECT series_id, median(gap) AS median_gap, min(gap) FILTER (WHERE c = top) AS mode_gap FROM (SELECT *, max(c) OVER (PARTITION BY series_id) AS top FROM (SELECT *, count(*) OVER (PARTITION BY series_id, gap) AS c FROM (
    SELECT series_id, epoch(ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts))::DOUBLE AS gap FROM bars) WHERE gap IS NOT NULL)) GROUP BY 1""", "bars")
def median_delta(spark, sf_dir):
    return calendar.cadence(_bars(spark, sf_dir))


@query("SELECT DISTINCT series_id, (isodow(ts) - 1)::INT AS weekday FROM bars", "bars")
def weekday_set(spark, sf_dir):
    return calendar.weekdays(_bars(spark, sf_dir))


@query("""WITH d AS (SELECT o_orderdate::DATE AS d FROM orders WHERE isodow(o_orderdate) < 6), l AS (SELECT max(d) AS d FROM d), f AS (SELECT (l.d + i::INT) AS day FROM l, range(1, 500) r(i))
    SELECT 'orders' AS series_id, row_number() OVER (ORDER BY day) AS step, day::TIMESTAMP AS ts FROM f WHERE isodow(day) IN (SELECT isodow(d) FROM d) QUALIFY step <= 60""")
def calendar_daily(spark, sf_dir):
    return calendar.extend_daily(B.daily_orders(spark, sf_dir).where("weekday(ts) < 5"), 60).withColumn("step", F.col("step").cast("long"))


KIND = "CASE isodow({0}) WHEN 5 THEN 'f' WHEN 6 THEN 'a' WHEN 7 THEN 'u' ELSE 'w' END"


@query(f"""WITH r AS (SELECT series_id, ts, ts::DATE AS day, {KIND.format('ts')} AS kind, max(ts::DATE) OVER (PARTITION BY series_id) AS last FROM bars),
    m AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY series_id, kind) AS model FROM r WHERE day < last) WHERE day = model),
    w AS (SELECT DISTINCT series_id, isodow(ts) AS d FROM bars), f AS (SELECT l.series_id, last + i::INT AS day FROM (SELECT DISTINCT series_id, last FROM r) l, range(1, 300) t(i)),
    g AS (SELECT f.series_id, f.day + (m.ts - m.day::TIMESTAMP) AS ts FROM f JOIN w ON w.series_id = f.series_id AND w.d = isodow(f.day) JOIN m ON m.series_id = f.series_id AND m.kind = {KIND.format('f.day')})
    SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS step, ts FROM g QUALIFY step <= 40""", "bars")
def calendar_intraday(spark, sf_dir):
    return calendar.extend_intraday(_bars(spark, sf_dir), 40).withColumn("step", F.col("step").cast("long"))


FUTURE = f"""r AS (SELECT series_id, ts, ts::DATE AS day, {KIND.format('ts')} AS kind, max(ts::DATE) OVER (PARTITION BY series_id) AS last FROM bars),
    m AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY series_id, kind) AS model FROM r WHERE day < last) WHERE day = model),
    w AS (SELECT DISTINCT series_id, isodow(ts) AS d FROM bars), f AS (SELECT l.series_id, last + i::INT AS day FROM (SELECT DISTINCT series_id, last FROM r) l, range(1, {7 * N + 8}) t(i)),
    g AS (SELECT f.series_id, f.day + (m.ts - m.day::TIMESTAMP) AS ts FROM f JOIN w ON w.series_id = f.series_id AND w.d = isodow(f.day) JOIN m ON m.series_id = f.series_id AND m.kind = {KIND.format('f.day')}),
    later AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS step, ts FROM g QUALIFY step <= {N}),
    times AS (SELECT series_id, bar_idx, ts, false AS is_projected FROM bars UNION ALL SELECT series_id, step + last_idx, ts, true FROM later JOIN (SELECT series_id, max(bar_idx) AS last_idx FROM bars GROUP BY 1) USING (series_id))"""


@query(f"WITH {FUTURE} SELECT series_id, bar_idx, round(composite, 5) AS composite, ts, is_projected FROM comp JOIN times USING (series_id, bar_idx)", "comp")
def projected_calendar(spark, sf_dir):
    """The composite with times: of bars, and of the calendar's next ones."""
    waves = rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N))
    return _r(analysis.projected(_bars(spark, sf_dir), waves, N), 5)


@query(f"""WITH c AS (SELECT * FROM waves JOIN (SELECT series_id, k AS cycle_id, period FROM top) USING (series_id, cycle_id) JOIN (SELECT DISTINCT series_id, start_idx, last_idx FROM win) USING (series_id)),
    s AS (SELECT series_id, bar_idx, sum(CASE WHEN bar_idx > last_idx - floor(1.5 * period) THEN value ELSE 0 END) AS y FROM c WHERE bar_idx <= last_idx GROUP BY ALL)
    SELECT series_id, round(avg((y - x) ** 2), 3) AS loss, count(*) AS n FROM wx JOIN s USING (series_id, bar_idx) GROUP BY 1""", "comp")
def recent_loss(spark, sf_dir):
    """Squared error of a composite whose cycles count in their last one and a half periods only, unscaled."""
    cycles, win = _cycles(spark, sf_dir), _win(spark, sf_dir)
    last = win.groupBy("series_id").agg(F.max("bar_idx").alias("last_idx"))
    waves = rebuild.composite(rebuild.recent_only(rebuild.sinusoids(cycles, N), cycles, last, 1.5))
    rows = win.select("series_id", "bar_idx", "x").join(waves, ["series_id", "bar_idx"])
    return rows.groupBy("series_id").agg(F.round(F.avg((F.col("composite") - F.col("x")) ** 2), 3).alias("loss"), F.count("*").alias("n"))


@query("""WITH j AS (SELECT w.series_id, bar_idx, composite, x, last_idx FROM wx w JOIN comp USING (series_id, bar_idx)),
    f AS (SELECT series_id, (max(x) - min(x)) / (max(composite) - min(composite)) AS b, min(x) AS lo, min(composite) AS c FROM j WHERE bar_idx > last_idx - 64 GROUP BY 1) SELECT series_id, bar_idx, round(lo + b * (composite - c), 5) AS fitted FROM j JOIN f USING (series_id)""", "comp")
def scale_minmax(spark, sf_dir):
    rows = _win(spark, sf_dir).select("series_id", "bar_idx", "x").join(rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)), ["series_id", "bar_idx"])
    return _r(rebuild.scaled_to(rows, "composite", "x", 64, "minmax").select("series_id", "bar_idx", "fitted"), 5)


@query(KPI + ", t AS (SELECT series_id, k AS cycle_id, period FROM top) SELECT series_id, bar_idx, round(sum(share * weight / period), 5) AS alignment FROM h JOIN t USING (series_id, cycle_id) GROUP BY ALL", "waves")
def alignment_by_period(spark, sf_dir):
    c = _cycles(spark, sf_dir)
    return _r(align.alignment(rebuild.sinusoids(c, N), c.select("series_id", "cycle_id", F.col("amplitude").alias("weight"), "period")), 5)


@query("SELECT DISTINCT trunc(10 ** (1 + i * 4 / 29.0::DOUBLE))::BIGINT AS hp_lambda FROM range(0, 30) r(i)")
def lambda_sequence(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in optimize.log_lambdas(10, 100000, 30)], "hp_lambda long")


DATES = ["2024-01-18 12:00:00", AS_OF, "2024-01-25 00:30:00"]


@query(f"""WITH d AS (SELECT unnest({DATES!r}) AS as_of), a AS (SELECT series_id, as_of, max(bar_idx) AS last FROM bars, d WHERE ts <= as_of::TIMESTAMP GROUP BY ALL)
    SELECT series_id || '@' || as_of AS series_id, ts, close, bar_idx - greatest(0, last - 39) AS bar_idx FROM bars JOIN a USING (series_id) WHERE bar_idx BETWEEN last - 39 AND last""", "bars")
def bars_at_dates(spark, sf_dir):
    return windowing.at_dates(_bars(spark, sf_dir), spark.createDataFrame([(d,) for d in DATES], "as_of string"), 40).select("series_id", "ts", "close", "bar_idx")


@query("""WITH l AS (SELECT t.*, bar_idx - as_of_idx AS idx_delta, bar_idx >= as_of_idx AS late, as_of_idx FROM turns t JOIN asofs USING (series_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY series_id, late ORDER BY abs(idx_delta)) AS n FROM l), k AS (SELECT *, CASE WHEN late THEN n ELSE -n END AS label FROM r WHERE n <= 3),
    v AS (SELECT k.*, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY bar_idx)) AS contiguous_delta FROM k),
    x AS (SELECT v.*, CASE WHEN idx_delta <= 0 THEN value - w.x END AS error FROM v LEFT JOIN wx w ON w.series_id = v.series_id AND w.bar_idx = v.bar_idx),
    u AS (SELECT series_id, label, unnest(['idx_delta', 'kind', 'value', 'contiguous_delta', 'error']) AS metric, unnest([idx_delta::DOUBLE, kind::DOUBLE, value, contiguous_delta, error]) AS metric_value FROM x)
    SELECT series_id, label, metric, round(metric_value, 5) AS metric_value FROM u UNION ALL
    SELECT a.series_id, 0, 'trend', coalesce((SELECT CASE WHEN kind = -1 THEN 1 ELSE -1 END FROM x WHERE x.series_id = a.series_id AND label = -1), -1)::DOUBLE FROM asofs a""", "asofs")
def minmax_features(spark, sf_dir):
    """Turning points of the composite around the as-of bar, with their errors against the detrended window, and the trend."""
    rows = rebuild.composite(rebuild.sinusoids(_cycles(spark, sf_dir), N)).join(_win(spark, sf_dir).select("series_id", "bar_idx", "x"), ["series_id", "bar_idx"], "left")
    return _r(analysis.min_max_features(rows, "composite", _as_of(spark, sf_dir), 3, "x").withColumn("label", F.col("label").cast("long")), 5)


# trades, parameters, tables


@query("""WITH t AS (SELECT t.series_id, min(bar_idx) FILTER (WHERE kind = 1) AS max_idx, min(bar_idx) FILTER (WHERE kind = -1) AS min_idx FROM turns t JOIN asofs a ON a.series_id = t.series_id AND bar_idx > as_of_idx - 64 GROUP BY 1)
    SELECT t.series_id, max_idx, min_idx, round(coalesce(s.close - b.close, 0), 6) AS pl FROM t LEFT JOIN bars s ON s.series_id = t.series_id AND s.bar_idx = max_idx + 1 LEFT JOIN bars b ON b.series_id = t.series_id AND b.bar_idx = min_idx + 1""", "asofs")
def trade_pl(spark, sf_dir):
    at = _as_of(spark, sf_dir).withColumn("as_of_idx", F.col("as_of_idx") - 64)
    return _r(backtest.trade(_bars(spark, sf_dir), backtest.first_turns(_turns(spark, sf_dir), at)))


TRADES = "p AS (SELECT series_id, bar_idx AS as_of, close - open AS pl FROM bars)"


@query(f"""WITH {TRADES}, i AS (SELECT *, sum((pl > 0)::INT) OVER (PARTITION BY series_id ORDER BY as_of) AS g FROM p), r AS (SELECT *, sum(least(pl, 0)) OVER (PARTITION BY series_id, g ORDER BY as_of) AS run FROM i)
    SELECT series_id, round(sum(pl), 6) AS pl_sum, round(least(0, min(pl)), 6) AS worst_loss, round(least(0, min(run)), 6) AS worst_running_loss, round(coalesce(sum(pl) FILTER (WHERE pl > 0), 0), 6) AS profit_sum, count(*) FILTER (WHERE pl > 0) AS profits,
    round(coalesce(sum(pl) FILTER (WHERE pl < 0), 0), 6) AS loss_sum, count(*) FILTER (WHERE pl < 0) AS losses, round(sum(pl) FILTER (WHERE pl > 0) / -sum(pl) FILTER (WHERE pl < 0), 6) AS profit_ratio,
    round(count(*) FILTER (WHERE pl > 0) / (count(*) FILTER (WHERE pl <> 0))::DOUBLE, 6) AS win_share FROM r GROUP BY 1""", "bars")
def pl_fold(spark, sf_dir):
    return _r(backtest.fold(_bars(spark, sf_dir).select("series_id", F.col("bar_idx").alias("as_of"), (F.col("close") - F.col("open")).alias("pl"))))


@query(f"WITH {TRADES} SELECT series_id, round(sum(pl) / count(*) FILTER (WHERE pl > 0), 6) AS fitness FROM p GROUP BY 1", "bars")
def positive_mean_fitness(spark, sf_dir):
    return _r(backtest.positive_mean(_bars(spark, sf_dir).select("series_id", (F.col("close") - F.col("open")).alias("fitness"))))


def _history(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("optimization_label"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("analysis_reference_date"), F.col("o_totalprice").alias("fitness"), F.col("o_orderkey").alias("parameter_id"))


HISTORY = "SELECT o_orderpriority AS optimization_label, date_trunc('month', o_orderdate)::TIMESTAMP AS analysis_reference_date, o_totalprice AS fitness, o_orderkey AS parameter_id FROM orders"


@query(f"""SELECT * FROM ({HISTORY}) WHERE analysis_reference_date <= TIMESTAMP '1997-03-15' QUALIFY row_number() OVER (PARTITION BY optimization_label ORDER BY analysis_reference_date DESC, fitness, parameter_id) = 1""")
def param_pick(spark, sf_dir):
    return backtest.pick_parameters(_history(spark, sf_dir), "1997-03-15 00:00:00")


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE o_orderstatus END AS status, NULL::BIGINT AS added FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE o_orderstatus END, o_custkey FROM orders WHERE o_orderkey % 2 = 1""")
def upsert_history(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("added"))
    return store.upsert(o.where("id % 2 = 0").drop("added"), o.where("id % 2 = 1"), "status", "high", "price > 200000").drop("price")


@query("SELECT id, a, b FROM (SELECT n_nationkey AS id, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region)")
def union_by_name(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("a"))
    return store.union_by_name(n, spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("b")))


@query("SELECT DISTINCT o_orderdate AS as_of FROM orders WHERE o_orderdate NOT IN (SELECT l_shipdate FROM lineitem WHERE l_quantity > 45)")
def anti_join_resume(spark, sf_dir):
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("as_of")).distinct()
    return store.to_do(dates, spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_shipdate").alias("as_of")))


@query("SELECT o_orderdate AS as_of, min(o_orderkey) AS id FROM orders GROUP BY 1")
def dedup_first(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("id"))
    return store.first_of_each(rows, "as_of", "id")


# fits and whole analyses: no SQL; tests hold them to their invariants


def _fit(spark, sf_dir, fit) -> DataFrame:
    reference = _win(spark, sf_dir).select("series_id", "bar_idx", F.col("x").alias("value"))
    return _r(rebuild.fit_cycles(reference, _cycles(spark, sf_dir), fit), 5)


SEARCH = optimize.SearchConfig(population=16, generations=8)


@query()
def algebraic_fit(spark, sf_dir):
    return _fit(spark, sf_dir, rebuild.algebraic)


@query()
def varpro(spark, sf_dir):
    return _fit(spark, sf_dir, rebuild.varpro)


@query()
def ga_fit(spark, sf_dir):
    return _fit(spark, sf_dir, analysis.FITS["genetic"](SEARCH))


@query()
def ga_frequencies_fit(spark, sf_dir):
    return _fit(spark, sf_dir, analysis.FITS["genetic_frequencies"](SEARCH))


@query()
def tpe_fit(spark, sf_dir):
    return _fit(spark, sf_dir, analysis.FITS["tpe"](SEARCH))


@query()
def derivative_free_fit(spark, sf_dir):
    return _fit(spark, sf_dir, analysis.FITS["derivative_free"](SEARCH))


@query()
def mono_frequency_fit(spark, sf_dir):
    return _fit(spark, sf_dir, optimize.mono_frequency)


SINGLE = AnalysisConfig(detrend=DetrendConfig(kind="hp"), spectrum=SpectrumConfig(N, LOW, HIGH), projection=ProjectionConfig(cycles=3))
MULTI = MultiConfig(bands=(Band(96, 1, 8, 16, 65.0), Band(N, 2, 16, 40, 1600.0)))


@query()
def single_range_analysis(spark, sf_dir):
    out = analysis.analyze(_bars(spark, sf_dir), SINGLE).cycles
    return _r(out.select("series_id", "k", "period", "amplitude", "phase", "bartels_score", "savgol_corr", "derivative_corr", "phase_rmse", "peak_ratio", "global_score", "rank", "dominant_period"), 5)


@query()
def multi_range_analysis(spark, sf_dir):
    return _r(analysis.analyze_bands(_bars(spark, sf_dir), MULTI).scaled.select("series_id", "bar_idx", "composite", "scaled"), 5)


@query()
def features_by_date(spark, sf_dir):
    return _r(analysis.features_for_dates(_bars(spark, sf_dir), ["2024-01-18 12:00:00", AS_OF], None, MULTI), 5)


@query()
def feature_row(spark, sf_dir):
    """One wide row per series and date."""
    return _r(analysis.feature_rows(_bars(spark, sf_dir), DATES[:2], MULTI), 5)


@query()
def scaled_outputs(spark, sf_dir):
    return _r(analysis.analyze_bands(_bars(spark, sf_dir), MULTI).outputs, 5)


@query()
def fidelity_of_fit(spark, sf_dir):
    return analysis.analyze_bands(_bars(spark, sf_dir), MULTI).fidelity


@query()
def hyper_search_mse(spark, sf_dir):
    """Bands compared by the mean loss of their fits over dates."""
    return _r(analysis.hyper_search(_bars(spark, sf_dir), [Band(N, 2, 16, 40, 1600.0), Band(96, 1, 8, 16, 65.0)], DATES[:2], MULTI, "mse"), 5)


@query()
def plot_lines(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return _r(analysis.plot_frame(b, analysis.analyze_bands(b, MULTI)), 5)


@query()
def hyper_generations(spark, sf_dir):
    return _r(analysis.evolve_bands(_bars(spark, sf_dir), [AS_OF], MultiConfig(bands=(Band(96, 1, 8, 20, 65.0),)), population=3, generations=2), 5)


@query()
def hyper_search(spark, sf_dir):
    return _r(analysis.hyper_search(_bars(spark, sf_dir), [Band(N, 2, 16, 40, 1600.0), Band(N, 2, 30, 40, 1600.0), Band(96, 1, 8, 16, 65.0)], [AS_OF], MULTI), 5)
