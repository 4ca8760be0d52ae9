"""Whole analyses of all series at once: one band, several bands, many dates, and searches over their settings."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import align, backtest, calendar, detrend, kernel, optimize, rebuild, score, spectrum, windowing
from ..sources import store
from .config import AnalysisConfig, Band, DetrendConfig, MultiConfig, ProjectionConfig, SpectrumConfig


@dataclass
class AnalysisResult:
    """Frames of a single-range analysis. Window, peaks and cycles are checkpointed, the others start from them."""

    window: DataFrame
    spectrum: DataFrame
    peaks: DataFrame
    cycles: DataFrame
    signals: DataFrame
    composite: DataFrame
    status: str = "ok"


@dataclass
class MultiResult:
    """Frames of a multi-range analysis. The fitted cycles are checkpointed, the others start from them."""

    cycles: DataFrame
    signals: DataFrame
    composite: DataFrame
    alignment: DataFrame
    scaled: DataFrame
    outputs: DataFrame
    fidelity: DataFrame
    status: str = "ok"


def detrended(bars: DataFrame, column: str, config: DetrendConfig, max_period: float) -> DataFrame:
    """series_id, bar_idx, detrended by the configured method."""
    kind = config.kind
    if kind == "hp":
        return kernel.hp_filter(bars, column, config.hp_lambda)
    if kind == "band_pass":
        if not config.hp_lambda_min:  # no fast cutoff: nothing is taken off the high-pass
            return kernel.hp_filter(bars, column, config.hp_lambda)
        return kernel.band_pass(bars, column, config.hp_lambda, config.hp_lambda_min)
    if kind == "linear":
        return detrend.linear_blocks(bars, column, config.linear_window).drop("block")
    if kind == "quadratic":
        return detrend.quadratic(bars, column)
    if kind == "jh":
        return kernel.jh_filter(bars, column, config.jh_lead, config.jh_lags)
    if kind == "lowess":
        return kernel.lowess_filter(bars, column, config.lowess_k, max_period)
    return detrend.none(bars, column)


def analyze(bars: DataFrame, config: AnalysisConfig) -> AnalysisResult:
    """Window, detrend, spectrum, peaks, scores, dominant cycles and their sinusoids, for every series with enough bars.

    Bars after as_of are cut before detrending unless allow_lookahead is set.
    """
    s = config.spectrum
    known = bars if config.as_of is None or config.allow_lookahead else windowing.as_of_cut(bars, config.as_of)
    smooth = detrended(known, config.data.column, config.detrend, s.max_period)
    window = windowing.last_bars(windowing.as_of_cut(known, config.as_of) if config.as_of else known, s.num_samples).join(smooth, ["series_id", "bar_idx"])
    window = windowing.fill_null(window, "detrended").withColumn("x", F.col("detrended"))
    if s.kaiser_beta is not None:
        window = spectrum.tapered(window, "x", s.num_samples, s.kaiser_beta).drop("x", "weight").withColumnRenamed("tapered", "x")
    window = store.cut(window)
    spec = spectrum.spectrum_kernel(window, s.num_samples, s.min_period, s.max_period, "x")
    peaks = spectrum.period_filter(spectrum.spectral_peaks(spec, s.peak_order), s.min_period, s.max_period, s.limit_harmonics)
    peaks = spectrum.bartels(window, store.cut(peaks), config.data.column)
    up = ["savgol_corr", "derivative_corr", "scaled_amplitude"]
    if s.bartels_threshold > 0:
        peaks, up = peaks.where(F.col("bartels_score") >= s.bartels_threshold), ["bartels_score", *up]
    peaks = score.global_score(score.scored(window, peaks), up, ["phase_rmse", "peak_ratio"])
    starts = window.groupBy("series_id").agg(F.min("start_idx").alias("start_idx"))
    cycles = store.cut(score.dominant(peaks, config.projection.cycles, config.projection.rank_by).join(starts, "series_id").withColumn("cycle_id", F.col("k")))
    signals = rebuild.sinusoids(cycles, s.num_samples)
    return AnalysisResult(window, spec, peaks, cycles, signals, rebuild.composite(signals))


FITS = {
    "algebraic": lambda c: rebuild.algebraic,
    "varpro": lambda c: rebuild.varpro,
    "genetic": lambda c: optimize.fitter(optimize.genetic, c),
    "genetic_frequencies": lambda c: (lambda y, z: optimize.genetic_frequencies(y, z, c)),
    "tpe": lambda c: optimize.fitter(optimize.parzen, c),
    "derivative_free": lambda c: optimize.fitter(optimize.pattern, c),
    "mono_frequency": lambda c: optimize.mono_frequency,
}


def _band_table(bars: DataFrame, config: MultiConfig) -> DataFrame:
    rows = [(i, b.num_samples, b.cycles, float(b.min_period), float(b.max_period), float(b.hp_lambda), b.lambda_min) for i, b in enumerate(config.bands)]
    return bars.sparkSession.createDataFrame(rows, "band int, num_samples int, cycles int, min_period double, max_period double, hp_lambda double, lambda_min double")


def analyze_bands(bars: DataFrame, config: MultiConfig) -> MultiResult:
    """analyze() per band, one table of cycles, amplitudes and phases anew on the reference, a fit, composite and alignment."""
    if config.as_of is not None:
        bars = windowing.as_of_cut(bars, config.as_of)
    known = _band_table(bars, config)
    bars = store.cut(windowing.protective_cut(bars, known))
    fast = {}
    if config.detrend.kind == "band_pass":  # each band's fast cutoff: given, of the band that ends where it begins, or from its shortest period
        fast = {r["band"]: r["lambda_min"] for r in windowing.band_lambdas(known).collect()}
    parts, windows = [], []
    for i, b in enumerate(config.bands):
        d = replace(config.detrend, hp_lambda=b.hp_lambda, hp_lambda_min=fast.get(i, b.lambda_min))
        one = analyze(bars, AnalysisConfig(detrend=d, spectrum=SpectrumConfig(b.num_samples, b.min_period, b.max_period), projection=ProjectionConfig(b.cycles)))
        parts.append(one.cycles.withColumn("band", F.lit(i)))
        windows.append(one.window)
    # positions are comparable: all bands share the cut frame
    cycles = parts[0]
    for p in parts[1:]:
        cycles = cycles.unionByName(p)
    cycles = cycles.withColumn("cycle_id", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("period"), "band", "k")).cast("long"))
    best = max(range(len(config.bands)), key=lambda i: (config.bands[i].num_samples if config.reference == "longest" else config.bands[i].hp_lambda, -i))
    longest = windows[best].select("series_id", "bar_idx", "x")
    if config.smooth_reference:
        width = max(3, int(config.bands[best].min_period / 2) | 1)
        longest = kernel.savgol(longest, "x", width).withColumnRenamed("smoothed", "x")
    reference = windowing.minmax(longest, "x", -100.0, 100.0).select("series_id", "bar_idx", F.col("scaled").alias("value"))
    cycles = rebuild.reestimated(reference, cycles)
    fitted = store.cut(rebuild.fit_cycles(reference, cycles, FITS[config.fit](config.search)))  # few rows that all frames below start from
    signals = rebuild.sinusoids(fitted, max(b.num_samples for b in config.bands))
    whole = rebuild.composite(signals)
    scaled = windowing.minmax(whole, "composite", -100.0, 100.0)
    plain = rebuild.composite(rebuild.sinusoids(fitted.drop("best_amplitude", "best_frequency", "best_phase"), max(b.num_samples for b in config.bands)))
    weights = fitted.select("series_id", "cycle_id", F.col("best_amplitude").alias("weight"), (1 / F.col("best_frequency")).alias("period"))
    even, heavy = align.alignment(signals), align.alignment(signals, weights)
    outputs = scaled_outputs(windows[best].select("series_id", "bar_idx", F.col("x").alias("detrended")), whole, plain, even, heavy)
    fit = rebuild.fidelity(whole.join(reference, ["series_id", "bar_idx"]), "composite", "value")
    return MultiResult(fitted, signals, whole, even, scaled, store.cut(outputs), fit)


def scaled_outputs(detrended: DataFrame, whole: DataFrame, plain: DataFrame, even: DataFrame, heavy: DataFrame) -> DataFrame:
    """series_id, bar_idx, composite, transform, alignment, weighted_alignment, detrended: both composites scaled to the detrended window's range, both indicators to [-1, 1]."""
    keys = ["series_id", "bar_idx"]
    rows = whole.join(plain.withColumnRenamed("composite", "transform"), keys).join(even, keys).join(heavy.withColumnRenamed("alignment", "weighted_alignment"), keys)
    for c in ("composite", "transform", "alignment", "weighted_alignment"):
        rows = windowing.minmax(rows, c, 0.0, 1.0).drop(c).withColumnRenamed("scaled", c)
    span = detrended.groupBy("series_id").agg(F.min("detrended").alias("low"), F.max("detrended").alias("high"))
    rows = rows.join(span, "series_id").join(detrended, keys, "left")
    to_span = lambda c: (F.col("low") + F.col(c) * (F.col("high") - F.col("low"))).alias(c)
    return rows.select(*keys, to_span("composite"), to_span("transform"), (2 * F.col("alignment") - 1).alias("alignment"), (2 * F.col("weighted_alignment") - 1).alias("weighted_alignment"), "detrended")


def projected(bars: DataFrame, values: DataFrame, ahead: int) -> DataFrame:
    """values (series_id, bar_idx, ...) with ts and is_projected: the bar's own time, and past the last bar the calendar's next ones, at most `ahead`.

    Series with a day or more between most bars go on by days, others by the times of day they have had.
    """
    last = bars.groupBy("series_id").agg(F.max("bar_idx").alias("last_idx"))
    daily = calendar.cadence(bars).where("median_gap >= 86400").select("series_id")
    later = calendar.extend_daily(bars.join(daily, "series_id", "left_semi"), ahead).unionByName(calendar.extend_intraday(bars.join(daily, "series_id", "left_anti"), ahead))
    times = later.join(last, "series_id").select("series_id", (F.col("last_idx") + F.col("step")).alias("bar_idx"), "ts", F.lit(True).alias("is_projected"))
    times = bars.select("series_id", "bar_idx", "ts", F.lit(False).alias("is_projected")).unionByName(times)
    return values.join(times, ["series_id", "bar_idx"])


#: Signals whose turning points make features, and whether they are compared with the detrended window.
SIGNALS = {"composite": True, "transform": True, "alignment": False, "weighted_alignment": False}
METRICS = ("idx_delta", "kind", "value", "contiguous_delta", "error")


def min_max_features(rows: DataFrame, column: str, as_of: DataFrame, count: int, reference: str | None = None) -> DataFrame:
    """Long features of the turning points of one signal around the as-of bar: series_id, label, metric, metric_value.

    With a reference column of rows, `error` is the value less the reference, for turning points up to the as-of bar. The
    metric `trend` (label 0) is 1 after a minimum, else -1.
    """
    labels = align.labelled(align.turning_points(rows, column), as_of, count)
    error = F.lit(None).cast("double")
    if reference is not None:
        at = as_of.select("series_id", "as_of_idx")
        other = rows.join(at, "series_id").select("series_id", (F.col("bar_idx") - F.col("as_of_idx")).alias("idx_delta"), F.col(reference).alias("reference")).where("idx_delta <= 0")
        labels, error = labels.join(other, ["series_id", "idx_delta"], "left"), F.col("value") - F.col("reference")
    stack = "stack(5, 'idx_delta', cast(idx_delta as double), 'kind', cast(kind as double), 'value', value, 'contiguous_delta', contiguous_delta, 'error', error) as (metric, metric_value)"
    long = labels.withColumn("error", error).selectExpr("series_id", "label", stack)
    before = align.trend(labels)
    trend = as_of.select("series_id").join(before, "series_id", "left").select("series_id", F.lit(0).alias("label"), F.lit("trend").alias("metric"), F.coalesce("trend", F.lit(-1)).cast("double").alias("metric_value"))
    return long.unionByName(trend)


def features(result: MultiResult, as_of: DataFrame, count: int) -> DataFrame:
    """min_max_features of all four signals, with their name; the transform's composite is smoothed first."""
    out = None
    for name, compared in SIGNALS.items():
        rows = result.outputs.select("series_id", "bar_idx", name, "detrended")
        if name == "transform":
            rows = kernel.savgol(rows, name, 30).withColumnRenamed("smoothed", name).join(rows.drop(name), ["series_id", "bar_idx"])
        part = min_max_features(rows, name, as_of, count, "detrended" if compared else None).withColumn("signal", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _split(df: DataFrame) -> DataFrame:
    """series@date back to series_id and as_of."""
    name = F.col("series_id")
    return df.withColumn("as_of", F.regexp_extract(name, "@([^@]*)$", 1)).withColumn("series_id", F.regexp_extract(name, "^(.*)@[^@]*$", 1))


def _dated(bars: DataFrame, dates: list[str], config: MultiConfig) -> tuple[MultiResult, DataFrame, DataFrame]:
    """One multi-range analysis of every series as it stood at every date; the bars it saw, and its as-of bars. The plan's size doesn't depend on the number of dates."""
    asked = bars.sparkSession.createDataFrame([(d,) for d in dates], "as_of string")
    longest = max(config.bands, key=lambda b: (b.max_period, b.num_samples)).num_samples
    keep = max(int(1.5 * longest) + 1, *(b.num_samples for b in config.bands))
    seen = store.cut(windowing.at_dates(bars, asked, keep))
    result = analyze_bands(seen, replace(config, as_of=None))
    seen = windowing.protective_cut(seen, _band_table(seen, config))
    return result, seen, seen.groupBy("series_id").agg(F.max("bar_idx").alias("as_of_idx"))


def features_for_dates(bars: DataFrame, dates: list[str], done: DataFrame | None, config: MultiConfig, count: int = 3) -> DataFrame | None:
    """Features of each date without any yet, of all series, to be appended by as_of: one plan for all dates."""
    left = sorted(set(dates))
    if done is not None:
        asked = bars.sparkSession.createDataFrame([(d,) for d in left], "as_of string")
        left = sorted(r[0] for r in asked.join(done.select(F.col("as_of").cast("string")).distinct(), "as_of", "left_anti").collect())  # as many as were asked for
    if not left:
        return None
    result, _, at = _dated(bars, left, config)
    return _split(features(result, at, count))


def feature_rows(bars: DataFrame, dates: list[str], config: MultiConfig, count: int = 3) -> DataFrame:
    """One wide row per series and date: the as-of bar with its differences, the fit's loss, the scaled detrended value, and all features by name."""
    result, seen, at = _dated(bars, dates, config)
    long = features(result, at, count)
    name = F.concat_ws("_", "signal", F.when(F.col("label") > 0, F.concat(F.lit("p"), F.col("label"))).when(F.col("label") < 0, F.concat(F.lit("m"), -F.col("label"))).otherwise("now"), "metric")
    names = [f"{s}_{side}{i}_{m}" for s, compared in SIGNALS.items() for side in "mp" for i in range(1, count + 1) for m in METRICS if compared or m != "error"] + [f"{s}_now_trend" for s in SIGNALS]
    wide = long.withColumn("name", name).groupBy("series_id").pivot("name", names).agg(F.first("metric_value", True))
    base = windowing.bar_features(seen).join(seen.select("series_id", "bar_idx", "ts", "open", "high", "low", "close", "volume"), ["series_id", "bar_idx"])
    now = base.join(at, "series_id").where("bar_idx = as_of_idx").join(result.outputs.select("series_id", "bar_idx", "detrended"), ["series_id", "bar_idx"], "left").drop("bar_idx", "as_of_idx")
    loss = result.cycles.groupBy("series_id").agg(F.min("loss").alias("best_fitness"))
    return _split(now.join(loss, "series_id").join(wide, "series_id", "left"))


#: Weights of a back-test's values, in the order in which candidates are compared; losses are negative.
FITNESS = {"pl_sum": 1.0, "worst_loss": 0.4, "worst_running_loss": 0.4, "profit_sum": 1.0, "profits": 1.0, "loss_sum": 0.6, "losses": -0.6, "win_share": 1.0, "profit_ratio": 1.0}


def hyper_search(bars: DataFrame, candidates: list[Band], dates: list[str], config: MultiConfig, objective: str = "trading_pl") -> DataFrame:
    """One history row per candidate band and series, best first: nine trade values over the dates, or (`mse`) the mean loss of the fits.

    Candidates that break a rule get a penalty and no run. `fitness` is to be small: the weighted profit's negative, or the
    loss; ties go to the further weighted values in order. Each candidate's dates are one plan.
    """
    if objective not in ("trading_pl", "mse"):
        raise ValueError(f"unknown objective: {objective}")
    spark, out = bars.sparkSession, None
    values = ", ".join(f"{c} {'long' if c in ('profits', 'losses') else 'double'}" for c in FITNESS)
    for i, band in enumerate(candidates):
        if not 2 * band.min_period <= band.max_period <= band.num_samples / 2:
            part = spark.createDataFrame([(i, None, 1e9, *[None] * len(FITNESS))], f"candidate int, series_id string, fitness double, {values}")
        else:
            result, _, at = _dated(bars, dates, replace(config, bands=(band,)))
            if objective == "mse":
                part = _split(result.cycles.select("series_id", "loss").distinct()).groupBy("series_id").agg(F.avg("loss").alias("fitness"))
                part = part.select(F.lit(i).alias("candidate"), "series_id", "fitness", *[F.lit(None).cast("long" if c in ("profits", "losses") else "double").alias(c) for c in FITNESS])
            else:
                # positions after the as-of bar are read off the whole series
                here = _split(at).join(bars.select("series_id", "bar_idx", "ts"), "series_id").where(F.col("ts") <= F.col("as_of").cast("timestamp_ntz"))
                shift = here.groupBy("series_id", "as_of").agg((F.max("bar_idx") - F.max("as_of_idx")).alias("shift"))
                turns = _split(backtest.first_turns(align.turning_points(result.composite, "composite"), at)).join(shift, ["series_id", "as_of"])
                turns = turns.select("series_id", "as_of", (F.col("max_idx") + F.col("shift")).alias("max_idx"), (F.col("min_idx") + F.col("shift")).alias("min_idx"))
                trades = backtest.trade(bars, turns, "as_of").select("series_id", "as_of", "pl")
                part = backtest.fold(trades).withColumn("fitness", -F.col("pl_sum")).select(F.lit(i).alias("candidate"), "series_id", "fitness", *FITNESS)
        out = part if out is None else out.union(part)
    return out.orderBy("fitness", *[F.desc_nulls_last(F.col(c) * w) for c, w in FITNESS.items()], "candidate", "series_id")


def evolve_bands(bars: DataFrame, dates: list[str], config: MultiConfig, population: int = 6, generations: int = 2, seed: int = 5, objective: str = "trading_pl") -> DataFrame:
    """Hyper-parameter search by generations: one Spark job over candidates and dates each, one history row per candidate and series.

    The better half of a generation lives on; children take each setting from one of two parents and shift it by up to a fifth.
    """
    rng, best = random.Random(seed), config.bands[0]

    def shifted(b: Band) -> Band:
        move = lambda x, low: max(low, x * rng.uniform(0.8, 1.25))
        return replace(b, num_samples=max(16, int(move(b.num_samples, 16))), min_period=move(b.min_period, 4.0), max_period=move(b.max_period, 10.0), hp_lambda=move(b.hp_lambda, 1.0), cycles=max(1, b.cycles + rng.choice((-1, 0, 1))))

    pool, history = [best, *[shifted(best) for _ in range(population - 1)]], None
    for g in range(generations):
        found = hyper_search(bars, pool, dates, config, objective).withColumn("generation", F.lit(g))
        settings = bars.sparkSession.createDataFrame([(i, b.num_samples, b.cycles, float(b.min_period), float(b.max_period), float(b.hp_lambda)) for i, b in enumerate(pool)], "candidate int, num_samples int, cycles int, min_period double, max_period double, hp_lambda double")
        found = found.join(F.broadcast(settings), "candidate")
        history = found if history is None else history.unionByName(found)
        order = [r[0] for r in found.groupBy("candidate").agg(F.avg("fitness").alias("f")).orderBy("f", "candidate").collect()]  # one row per candidate
        alive = [pool[i] for i in order[: max(2, population // 2)]]
        pool = list(alive)
        while len(pool) < population:
            a, b = rng.sample(alive, 2)
            pool.append(shifted(replace(a, min_period=b.min_period) if rng.random() < 0.5 else replace(a, hp_lambda=b.hp_lambda)))
    return history


def plot_frame(bars: DataFrame, result: MultiResult) -> DataFrame:
    """What a chart of a multi-range analysis shows, in long form: close, composite and alignment, each scaled to [-100, 100]."""
    parts = [windowing.minmax(df.select("series_id", "bar_idx", F.col(c).alias("value")), "value", -100.0, 100.0).select("series_id", "bar_idx", F.lit(name).alias("line"), F.col("scaled").alias("value")) for name, df, c in (("close", bars, "close"), ("composite", result.composite, "composite"), ("alignment", result.alignment, "alignment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
