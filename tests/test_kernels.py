import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from periodica.functions import kernels as K
from periodica.operators import optimize, spectrum

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("lam", [17.0, 1600.0, 170000.0])
def test_hp_is_the_dense_solution(lam):
    y = RNG.normal(size=80).cumsum()
    d = np.diff(np.eye(80), 2, axis=0)
    assert np.allclose(K.hp_detrend(y, lam), y - np.linalg.solve(np.eye(80) + lam * d.T @ d, y), atol=1e-8)


def test_band_pass_is_a_difference_of_two_filters():
    y = RNG.normal(size=60)
    assert np.allclose(K.band_pass(y, 100, 5), K.hp_detrend(y, 100) - K.hp_detrend(y, 5))


@pytest.mark.parametrize("window", [3, 4, 7, 10, 11])
def test_savgol_gives_back_parabolas(window):
    x = np.arange(40.0)
    y = 3 - 2 * x + 0.5 * x * x
    out = K.savgol(y, window)
    if window % 2:
        assert np.allclose(out, y)
    else:  # an even window's centre is half a bar later; edges are at the bars themselves
        z, half = x + 0.5, window // 2
        assert np.allclose(out[half:-half], (3 - 2 * z + 0.5 * z * z)[half:-half])
        assert np.allclose(out[:half], y[:half]) and np.allclose(out[-half:], y[-half:])


def test_lowess_gives_back_lines_and_resists_an_outlier():
    y = 2 + 0.3 * np.arange(50)
    assert np.allclose(K.lowess(y, 0.4), y)
    z = y.copy()
    z[25] += 100
    assert abs(K.lowess(z, 0.4)[25] - y[25]) < 1


def test_lag_regression_leaves_nothing_of_a_linear_recurrence():
    y = [1.0, 2.0]
    for _ in range(60):
        y.append(1.2 * y[-1] - 0.5 * y[-2] + 1)
    out = K.lag_regression(np.array(y), 1, 2)
    assert np.isnan(out[:2]).all() and np.nanmax(np.abs(out)) < 1e-8


def test_indicators_on_simple_series():
    assert np.allclose(K.rsi(np.arange(40.0))[14:], 100)
    assert not K.rsi(np.ones(40)).any()
    line, signal, hist = K.macd(np.arange(80.0))
    assert np.isnan(line[:25]).all() and np.allclose(line[25:], 7) and np.allclose(hist[33:], 0)


@given(st.integers(1, 40))
@settings(max_examples=25, deadline=None)
def test_simpson_is_exact_for_parabolas_on_odd_points(half):
    x = np.arange(2 * half + 1.0)
    assert np.isclose(K.simpson(x * x), (2 * half) ** 3 / 3)


def test_composite_of_a_quarter_cycle():
    assert np.allclose(K.composite(4, [0.25], [0], [1], [0]), [0, 1, 0, -1])


def test_algebraic_fit_recovers_sinusoids_and_skips_short_ones():
    y = K.composite(200, [0.05, 0.08], [0.1, -0.4], [3.0, 1.5], [0, 20]) + 7
    amp, phase, c = K.algebraic_fit(y, [0.05, 0.08, 0.3], np.array([0, 20, 197]))
    assert np.allclose(amp, [3, 1.5, 0]) and np.allclose(phase, [0.1, -0.4, 0]) and np.isclose(c, 7)


def test_varpro_moves_to_the_true_frequency_within_bounds():
    y = K.composite(200, [0.0512], [0.3], [2.0], [0])
    amp, freq, phase = K.varpro_fit(y, [0.05], np.array([0]))
    assert np.isclose(freq[0], 0.0512, atol=1e-6) and np.isclose(amp[0], 2, atol=1e-3)
    _, freq, _ = K.varpro_fit(y, [0.04], np.array([0]))
    assert abs(freq[0] - 0.04) <= 0.5 / 200 + 1e-12


def test_cycle_loss_does_not_depend_on_scale_and_is_least_at_the_truth():
    ref = np.array([0, 100, 0, -100.0] * 4)
    true = K.cycle_loss(ref, [1.0], [0.25], [0.0], [0])
    assert true < 1e-9 and np.isclose(K.cycle_loss(ref, [9.0], [0.25], [0.0], [0]), true, atol=1e-9)
    assert K.cycle_loss(ref, [1.0], [0.25], [1.0], [0]) > 100
    assert K.cycle_loss(ref, [1.0], [0.25], [0.0], [0], "extrema") < 1e-9


@pytest.mark.parametrize("search", [optimize.genetic, optimize.parzen, optimize.pattern])
def test_searches_are_seeded_stay_in_bounds_and_improve(search):
    low, high, first = np.zeros(3), np.ones(3), np.full(3, 0.5)
    loss = lambda x: float(((x - 0.25) ** 2).sum())
    a = search(loss, low, high, first, 32, 40, np.random.default_rng(123))
    b = search(loss, low, high, first, 32, 40, np.random.default_rng(123))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1] < loss(first)
    assert (a[0] >= low).all() and (a[0] <= high).all()


def test_small_populations_still_evolve():
    best, loss = optimize.genetic(lambda x: float(((x - 0.25) ** 2).sum()), np.zeros(3), np.ones(3), np.full(3, 0.9), 4, 60, np.random.default_rng(1))
    assert loss < 0.3


def test_generalized_goertzel_counts_the_last_sample_twice():
    x = RNG.normal(size=16)
    n = np.arange(16)
    for b in (1.0, 2.5):
        plain = (x * np.exp(-2j * np.pi * b * n / 16)).sum()
        got = spectrum.generalized_goertzel(x, b)[0]
        assert np.isfinite(got) and not np.isclose(got, plain)


def test_grid_of_the_known_scenario():
    size, high = spectrum.grid_size(256, 10, 80)
    assert size == 4079 and high == 80
    assert np.isclose(256 * 80 / 1975, 10.3696202532)
