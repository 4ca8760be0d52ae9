import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from periodica.functions import kernels as K
from periodica.operators import align, backtest, calendar, detrend, kernel, rebuild, score, spectrum, windowing
from periodica.plans import analysis
from periodica.plans.config import AnalysisConfig, Band, DetrendConfig, MultiConfig, ProjectionConfig, SpectrumConfig
from periodica.sources import bars as B
from periodica.sources import store
from periodica.streaming import bars as S


def frame(spark, series: dict[str, list], start="2024-01-01", freq="D"):
    rows = []
    for name, values in series.items():
        for i, (t, v) in enumerate(zip(pd.date_range(start, periods=len(values), freq=freq), values, strict=True)):
            rows.append((name, t.to_pydatetime(), *[float(v) if v is not None else None] * 4, 10.0, i))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double, bar_idx long")


@pytest.fixture(scope="module")
def waves(spark):
    i = np.arange(200)
    return frame(spark, {"a": 5 * np.sin(2 * np.pi * i / 20) + 2 * np.sin(2 * np.pi * i / 12), "b": 3 * np.sin(2 * np.pi * i / 16) + 0.01 * i}).cache()


def test_amplitude_of_a_full_cycle_is_the_number_of_samples(spark):
    bars = frame(spark, {"s": np.sin(2 * np.pi * np.arange(32) / 8)})
    spec = spectrum.spectrum(windowing.last_bars(bars, 32), spectrum.frequency_grid(spark, 32, 4, 16).where("abs(period - 8) < 1e-9"), "close").collect()
    assert len(spec) == 1 and math.isclose(spec[0]["amplitude"], 32, rel_tol=1e-9)
    assert abs(math.remainder(spec[0]["phase"], 2 * math.pi)) < 1e-9


def test_spectrum_forms_agree(spark, waves):
    w = windowing.last_bars(waves, 96).withColumn("x", F.col("close"))
    a = spectrum.spectrum(w, spectrum.frequency_grid(spark, 96, 8, 30), "x")
    b = spectrum.spectrum_kernel(w, 96, 8, 30, "x").select("series_id", "k", F.col("amplitude").alias("other"))
    assert a.join(b, ["series_id", "k"]).where("abs(amplitude - other) > 1e-6").count() == 0


def test_bartels_is_near_zero_for_a_sine_and_not_for_noise(spark):
    i = np.arange(320)
    bars = frame(spark, {"sine": np.sin(2 * np.pi * i / 16), "noise": np.random.default_rng(0).normal(size=320)})
    peaks = spark.createDataFrame([("sine", 1, 16.0), ("noise", 1, 16.0)], "series_id string, k long, period double")
    got = {r["series_id"]: r["bartels_score"] for r in spectrum.bartels(bars, peaks, "close").collect()}
    assert got["sine"] < 1e-5 < 0.05 < got["noise"]


def test_series_that_are_too_short_are_left_out(spark):
    bars = frame(spark, {"short": [1, 2, 3], "long": list(range(10))})
    assert [r[0] for r in windowing.last_bars(bars, 8).select("series_id").distinct().collect()] == ["long"]


def test_null_and_nan_are_zero(spark):
    bars = frame(spark, {"s": [1, None, float("nan")]})
    assert [r[0] for r in windowing.fill_null(bars, "close").orderBy("bar_idx").select("close").collect()] == [1, 0, 0]


def test_constant_series_scale_to_something_finite(spark):
    bars = frame(spark, {"s": [4, 4, 4]})
    assert windowing.zscore(bars, "close").where("z = 0").count() == 3
    assert windowing.minmax(bars, "close").where("scaled = -1").count() == 3


def test_missing_as_of_raises(spark, waves):
    with pytest.raises(windowing.MissingAsOfError):
        windowing.require_as_of(waves, "1999-01-01 00:00:00")
    assert windowing.require_as_of(waves, "2024-01-05 13:00:00").count() == 2
    with pytest.raises(B.EmptySeriesError):
        B.require(waves.limit(0))


def test_average_rank_is_that_of_pandas(spark):
    values = [3.0, 1.0, None, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, i int, v double")
    got = [r[0] for r in df.withColumn("r", score.average_rank("v", ["series_id"])).orderBy("i").select("r").collect()]
    want = pd.Series(values).rank().tolist()
    assert [None if pd.isna(x) else x for x in want] == got


def test_nearest_peaks_take_the_lower_of_two(spark):
    d = spark.createDataFrame([("s", 5), ("s", 9)], "series_id string, pos long")
    s = spark.createDataFrame([("s", 3), ("s", 7)], "series_id string, pos long")
    assert [(r["pos"], r["near"]) for r in score.nearest_peaks(d, s).orderBy("pos").collect()] == [(5, 3), (9, 7)]


def test_quadratic_removes_parabolas_and_window_zero_is_one_line(spark):
    i = np.arange(30.0)
    bars = frame(spark, {"q": 1 + i + 2 * i * i, "l": 3 - 2 * i})
    assert detrend.quadratic(bars, "close").where("abs(detrended) > 1e-6").count() == 0
    assert detrend.linear_blocks(bars.where("series_id = 'l'"), "close", 0).where("abs(detrended) > 1e-9").count() == 0


@pytest.mark.parametrize("kind", ["none", "hp", "band_pass", "linear", "quadratic", "jh", "lowess"])
def test_every_detrending_runs(spark, waves, kind):
    out = analysis.detrended(waves, "close", DetrendConfig(kind=kind), 30)
    assert out.columns == ["series_id", "bar_idx", "detrended"] and out.count() == 400


def test_local_extrema_need_all_neighbours(spark):
    bars = frame(spark, {"s": [9, 1, 5, 1, 1, 8, 2, 9]})
    got = spectrum.local_extrema(bars, "close", 2, ["series_id"], "bar_idx").where("is_max").select("bar_idx").collect()
    assert [r[0] for r in got] == [2] or [r[0] for r in got] == [2, 5] or not got
    order1 = spectrum.local_extrema(bars, "close", 1, ["series_id"], "bar_idx").where("is_max").orderBy("bar_idx").select("bar_idx").collect()
    assert [r[0] for r in order1] == [2, 5]


def test_alignment_runs_from_one_extremum_to_the_next(spark):
    i = np.arange(40)
    sig = spark.createDataFrame([("s", 1, int(t), float(np.sin(2 * np.pi * t / 8))) for t in i], "series_id string, cycle_id long, bar_idx long, value double")
    got = {r["bar_idx"]: r["alignment"] for r in align.alignment(sig).collect()}
    # maxima at 2, 10, ...; minima at 6, 14, ...: at 3 a quarter of the way down is gone
    assert math.isclose(got[3], 0.75) and math.isclose(got[7], -0.75) and got[0] == 0


def test_labels_count_outwards_from_the_as_of_bar(spark):
    pts = spark.createDataFrame([("s", b, float(v), k) for b, v, k in [(2, 5, 1), (4, 1, -1), (7, 6, 1), (9, 2, -1)]], "series_id string, bar_idx long, value double, kind int")
    at = spark.createDataFrame([("s", 7)], "series_id string, as_of_idx long")
    got = {r["label"]: (r["idx_delta"], r["contiguous_delta"]) for r in align.labelled(pts, at, 2).collect()}
    assert got == {-2: (-5, None), -1: (-3, 4.0), 1: (0, 5.0), 2: (2, 4.0)}
    assert align.trend(align.labelled(pts, at, 2)).first()["trend"] == 1


def test_running_loss_is_cleared_by_a_profit(spark):
    pls = [-1, -2, 3, -4, 0, -1, 2]
    df = spark.createDataFrame([("s", i, float(p)) for i, p in enumerate(pls)], "series_id string, as_of int, pl double")
    r = backtest.fold(df).first()
    assert (r["worst_loss"], r["worst_running_loss"], r["profits"], r["losses"], r["pl_sum"]) == (-4, -5, 2, 4, -3)


def test_daily_calendar_skips_days_never_seen(spark):
    days = pd.bdate_range("2023-01-02", "2023-12-29")
    bars = spark.createDataFrame([("s", d.to_pydatetime()) for d in days], "series_id string, ts timestamp_ntz")
    out = calendar.extend_daily(bars, 256).agg(F.max("ts"), F.count("*")).first()
    assert str(out[0])[:10] == "2024-12-23" and out[1] == 256


def test_intraday_calendar_uses_the_days_own_template(spark):
    ts = [f"2024-01-{d:02d} {h}:00:00" for d in (1, 2, 3, 4, 5) for h in ("10", "11", *(["12"] if d != 5 else []))] + ["2024-01-08 10:00:00"]
    bars = spark.createDataFrame([("s", t) for t in ts], "series_id string, t string").select("series_id", F.to_timestamp_ntz("t").alias("ts"))
    out = [str(r["ts"]) for r in calendar.extend_intraday(bars, 14).orderBy("step").collect()]
    assert out[:3] == ["2024-01-09 10:00:00", "2024-01-09 11:00:00", "2024-01-09 12:00:00"]
    assert [x for x in out if x.startswith("2024-01-12")] == ["2024-01-12 10:00:00", "2024-01-12 11:00:00"]
    assert not any(x.startswith(("2024-01-13", "2024-01-14")) for x in out)


def test_parameters_of_an_empty_history_are_empty(spark):
    empty = spark.createDataFrame([], "optimization_label string, analysis_reference_date timestamp_ntz, fitness double, parameter_id long")
    assert backtest.pick_parameters(empty, "2024-01-01 00:00:00").count() == 0


def test_tables_append_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "as_of string, v double")
    store.append_dates(rows, str(tmp_path / "f"))
    done = spark.read.parquet(str(tmp_path / "f"))
    dates = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "as_of string")
    assert [r[0] for r in store.to_do(dates, done.select(F.col("as_of").cast("string"))).collect()] == ["2024-01-03"]
    path = store.save(spark, rows, str(tmp_path), "a b/c", "v 1")
    assert path.endswith("a_b_c/v_1")
    with pytest.raises(Exception):  # noqa: B017
        store.save(spark, rows, str(tmp_path), "a b/c", "v 1")
    assert store.digest(rows).first() == store.digest(rows.orderBy(F.desc("v"))).first()


def test_csv_bars(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Datetime,Open,High,Low,Close,Volume\n2024-01-02 10:00:00,1,2,0,1.5,9\n2024-01-01 10:00:00,1,2,0,1,9\n")
    got = B.read_csv(spark, str(p), "x", source_tz="America/New_York").orderBy("bar_idx").collect()
    assert [r["close"] for r in got] == [1, 1.5] and str(got[0]["ts"]) == "2024-01-01 15:00:00"


def test_sinusoids_prefer_fitted_values(spark):
    c = spark.createDataFrame([("s", 1, 9.0, 0.1, 1.0, 0, 1.0, 0.25, 0.0)], "series_id string, cycle_id long, amplitude double, frequency double, phase double, start_idx long, best_amplitude double, best_frequency double, best_phase double")
    got = [r["composite"] for r in rebuild.composite(rebuild.sinusoids(c, 2)).orderBy("bar_idx").collect()]
    assert np.allclose(got, [0, 1, 0, -1], atol=1e-12)


def test_single_range_finds_the_planted_periods(spark, waves):
    out = analysis.analyze(waves, AnalysisConfig(detrend=DetrendConfig(kind="hp", hp_lambda=50000), spectrum=SpectrumConfig(160, 8, 32, peak_order=10), projection=ProjectionConfig(cycles=2, rank_by="scaled_amplitude")))
    got = out.cycles.select("series_id", "period").toPandas()
    assert min(abs(got[got.series_id == "a"].period - 20)) < 0.6 and min(abs(got[got.series_id == "a"].period - 12)) < 0.4
    assert min(abs(got[got.series_id == "b"].period - 16)) < 0.5
    assert out.signals.groupBy("series_id", "cycle_id").count().where("count <> 320").count() == 0


def test_no_look_ahead_before_the_as_of_date(spark, waves):
    cfg = AnalysisConfig(detrend=DetrendConfig(kind="hp"), spectrum=SpectrumConfig(96, 8, 24), as_of="2024-05-15")
    a = analysis.analyze(waves, cfg).cycles.select("series_id", "k", "amplitude")
    b = analysis.analyze(windowing.as_of_cut(waves, "2024-05-15"), cfg).cycles.select("series_id", "k", "amplitude")
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("fit", ["algebraic", "varpro", "genetic", "genetic_frequencies", "tpe", "derivative_free", "mono_frequency"])
def test_every_fit_gives_finite_cycles(spark, waves, fit):
    from periodica.operators.optimize import SearchConfig

    out = analysis.analyze_bands(waves, MultiConfig(bands=(Band(96, 1, 8, 14, 65.0), Band(128, 1, 14, 30, 1600.0)), fit=fit, search=SearchConfig(population=8, generations=3)))
    rows = out.cycles.collect()
    assert rows and all(math.isfinite(r["loss"]) and math.isfinite(r["best_amplitude"]) for r in rows)
    assert out.composite.count() > 0


def test_configs_check_their_values():
    for bad in (lambda: DetrendConfig(kind="x"), lambda: SpectrumConfig(min_period=80, max_period=10), lambda: SpectrumConfig(num_samples=2), lambda: MultiConfig()):
        with pytest.raises(ValueError):
            bad()
    assert AnalysisConfig().flat()["num_samples"] == 256


def test_streamed_bars_are_the_batch_ones(spark, tmp_path):
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i), "s", float(i % 5)) for i in range(200)]
    df = spark.createDataFrame([(a, b.to_pydatetime(), c, d) for a, b, c, d in rows], "event_id long, ts timestamp, event_type string, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    S.on_close(S.stream_bars(stream, F.col("event_type"), "ts", "value", "event_id"), lambda d, _: d.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    batch = B.resample(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), F.col("event_type"), "ts", "value", "event_id", "hour")
    got = {(str(r["ts"]), r["close"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(str(r["ts"]), r["close"]) for r in batch.collect()}
    assert got and got <= want and len(want) - len(got) <= 4  # the last hours wait for the watermark


def test_log_events_are_read_back(spark, tmp_path):
    import logging

    from periodica.sources import logs

    log = logs.RunLog("r1", logging.FileHandler(tmp_path / "run.jsonl"), "INFO")
    log.event("INFO", "fit", "fit_cycles", "done", 0.5, ticker="s", loss=1.25)
    log.event("DEBUG", "fit", "fit_cycles", "hidden")
    with pytest.raises(ValueError):
        log.event("INFO", "nothing", "f", "m")
    rows = logs.read(spark, str(tmp_path / "run.jsonl")).collect()
    assert len(rows) == 1 and rows[0]["context"] == {"loss": "1.25"} and rows[0]["elapsed_seconds"] == 0.5


def test_reestimation_recovers_amplitude_and_phase(spark):
    i = np.arange(60)
    ref = spark.createDataFrame([("s", int(t), float(3 * np.sin(2 * np.pi * 0.1 * (t - 20) + 0.7))) for t in i], "series_id string, bar_idx long, value double")
    cyc = spark.createDataFrame([("s", 1, 0.1, 20, 0.0, 0.0)], "series_id string, cycle_id long, frequency double, start_idx long, amplitude double, phase double")
    r = rebuild.reestimated(ref, cyc).first()
    assert math.isclose(r["amplitude"], 3 * 40, rel_tol=1e-9) and math.isclose(r["phase"], 0.7, abs_tol=1e-9)
