"""Seeded searches over amplitudes, frequencies and phases of one series' cycles, for rebuild.fit_cycles."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..functions import kernels as K


def log_lambdas(low: float, high: float, n: int) -> list[int]:
    """Distinct whole numbers, evenly spaced by their logarithms."""
    return np.unique(np.logspace(np.log10(low), np.log10(high), n).astype(int)).tolist()


@dataclass(frozen=True)
class SearchConfig:
    population: int = 40
    generations: int = 30
    seed: int = 7
    frequency_share: float = 0.10
    phase_share: float = 0.10
    fitness: str = "mse"
    initial: str = "transform"
    multiplier: float | None = None
    crossover: str = "block"

    def __post_init__(self) -> None:
        if self.population < 2 or self.generations < 0:
            raise ValueError("population must be 2 at least, generations 0 at least")
        if self.fitness not in ("mse", "extrema") or self.initial not in ("random", "middle", "transform") or self.crossover not in ("block", "two_point"):
            raise ValueError("unknown fitness, initial amplitudes or crossover")


def bounds(y: np.ndarray, cycles: pd.DataFrame, config: SearchConfig) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude 0 to the range, frequency and phase around the transform's values."""
    f, p, k = cycles["frequency"].to_numpy(), cycles["phase"].to_numpy(), len(cycles)
    turn = config.phase_share * 2 * np.pi
    return np.concatenate([np.zeros(k), f * (1 - config.frequency_share), p - turn]), np.concatenate([np.full(k, float(np.ptp(y)) or 1.0), f * (1 + config.frequency_share), p + turn])


def objective(y: np.ndarray, cycles: pd.DataFrame, config: SearchConfig) -> Callable[[np.ndarray], float]:
    k, start = len(cycles), cycles["offset"].to_numpy()
    return lambda x: K.cycle_loss(y, x[:k], x[k : 2 * k], x[2 * k :], start, config.fitness, multiplier=config.multiplier)


def seeded(cycles: pd.DataFrame, config: SearchConfig) -> np.random.Generator:
    """The same numbers for the same series and seed on any worker."""
    return np.random.default_rng([config.seed, zlib.crc32(str(cycles["series_id"].iloc[0]).encode())])


def start_point(y: np.ndarray, cycles: pd.DataFrame, config: SearchConfig, rng: np.random.Generator) -> np.ndarray:
    low, high = bounds(y, cycles, config)
    k = len(cycles)
    amp = {"random": lambda: rng.uniform(low[:k], high[:k]), "middle": lambda: (low[:k] + high[:k]) / 2, "transform": lambda: np.clip(cycles["amplitude"].to_numpy() / max(1, len(y)), low[:k], high[:k])}[config.initial]()
    return np.concatenate([amp, cycles["frequency"], cycles["phase"]])


def genetic(lossfn, low, high, first, population, generations, rng, crossover: str = "block") -> tuple[np.ndarray, float]:
    """Elite of a quarter at most, tournaments of three, crossover by thirds (amplitudes, frequencies, phases) or between two points, mutation by thirds; the best ever seen wins."""
    pool = rng.uniform(low, high, (population, len(low)))
    pool[0] = first
    loss = np.array([lossfn(x) for x in pool])
    best, least = pool[loss.argmin()].copy(), loss.min()
    elite, third = min(10, population // 4), max(1, len(low) // 3)
    for _ in range(generations):
        pick = lambda: pool[min(rng.integers(0, population, 3), key=lambda i: loss[i])]
        children = [pool[i].copy() for i in np.argsort(loss, kind="stable")[:elite]]
        while len(children) < population:
            a, b = pick().copy(), pick()
            if crossover == "block":
                block = slice(third * (c := int(rng.integers(0, 3))), third * (c + 1))
            else:
                block = slice(*sorted(rng.integers(0, len(low) + 1, 2)))
            a[block] = b[block]
            block = slice(third * (c := int(rng.integers(0, 3))), third * (c + 1))
            hit = rng.random(len(a[block])) < 0.3
            a[block] = np.where(hit, rng.uniform(low[block], high[block]), a[block])
            children.append(a)
        pool = np.array(children)
        loss = np.array([lossfn(x) for x in pool])
        if loss.min() < least:
            best, least = pool[loss.argmin()].copy(), loss.min()
    return best, float(least)


def parzen(lossfn, low, high, first, population, generations, rng, good: float = 0.25) -> tuple[np.ndarray, float]:
    """Tree-structured Parzen search with independent kernels: samples near the good points, kept by the ratio of densities."""
    seen = [first, *rng.uniform(low, high, (population, len(low)))]
    loss = [lossfn(x) for x in seen]
    for _ in range(generations):
        order = np.argsort(loss)
        top = np.array([seen[i] for i in order[: max(2, int(good * len(order)))]])
        rest = np.array([seen[i] for i in order[len(top) :]])
        width = np.maximum((high - low) / len(top), 1e-12)
        tries = np.clip(top[rng.integers(0, len(top), 24)] + rng.normal(0, 1, (24, len(low))) * width, low, high)
        dense = lambda pts: np.log(np.exp(-0.5 * ((tries[:, None] - pts[None]) / width) ** 2).mean(axis=1) + 1e-12).sum(axis=1)
        x = tries[(dense(top) - dense(rest)).argmax()] if len(rest) else tries[0]
        seen.append(x)
        loss.append(lossfn(x))
    i = int(np.argmin(loss))
    return seen[i], float(loss[i])


def pattern(lossfn, low, high, first, population, generations, rng) -> tuple[np.ndarray, float]:
    """Derivative-free search along coordinates with halving steps."""
    x, best = np.clip(first, low, high), lossfn(np.clip(first, low, high))
    step = (high - low) / 4
    for _ in range(generations):
        moved = False
        for i in rng.permutation(len(x)):
            for sign in (1, -1):
                y = x.copy()
                y[i] = np.clip(y[i] + sign * step[i], low[i], high[i])
                if (v := lossfn(y)) < best:
                    x, best, moved = y, v, True
        if not moved:
            step = step / 2
    return x, float(best)


def fitter(search, config: SearchConfig = SearchConfig()) -> Callable[[np.ndarray, pd.DataFrame], pd.DataFrame]:
    def fit(y: np.ndarray, cycles: pd.DataFrame) -> pd.DataFrame:
        rng, k = seeded(cycles, config), len(cycles)
        low, high = bounds(y, cycles, config)
        extra = {"crossover": config.crossover} if search is genetic else {}
        best, least = search(objective(y, cycles, config), low, high, start_point(y, cycles, config, rng), config.population, config.generations, rng, **extra)
        return cycles.assign(best_amplitude=best[:k], best_frequency=best[k : 2 * k], best_phase=best[2 * k :], loss=least)

    return fit


def genetic_frequencies(y, cycles, config: SearchConfig = SearchConfig()) -> pd.DataFrame:
    """Genetic search over frequencies alone; amplitudes and phases by least squares."""
    rng, k = seeded(cycles, config), len(cycles)
    low, high = bounds(y, cycles, config)
    start = cycles["offset"].to_numpy()

    def lossfn(f):
        amp, phase, _ = K.algebraic_fit(y, f, start)
        return K.cycle_loss(y, amp, f, phase, start, config.fitness)

    f, least = genetic(lossfn, low[k : 2 * k], high[k : 2 * k], cycles["frequency"].to_numpy(), config.population, config.generations, rng)
    amp, phase, _ = K.algebraic_fit(y, f, start)
    return cycles.assign(best_amplitude=amp, best_frequency=f, best_phase=phase, loss=least)


def mono_frequency(y, cycles, steps: int = 100) -> pd.DataFrame:
    """From the slowest cycle to the fastest: the amplitude with the least error over the last 2.5 periods, each added once."""
    out, total = cycles.sort_values("frequency").copy(), np.zeros(len(y))
    amps = {}
    for c in out.itertuples():
        wave = K.composite(len(y), [c.frequency], [c.phase], [1.0], [c.offset])
        tail = slice(max(0, len(y) - int(2.5 / c.frequency)), len(y))
        tries = np.linspace(float(np.ptp(y)), 0, steps + 1)
        best = min(tries, key=lambda a: float(((total[tail] + a * wave[tail] - y[tail]) ** 2).mean()))
        total += best * wave
        amps[c.cycle_id] = best
    amp = cycles["cycle_id"].map(amps).to_numpy(float)
    f, p, s = (cycles[x].to_numpy() for x in ("frequency", "phase", "offset"))
    return cycles.assign(best_amplitude=amp, best_frequency=f, best_phase=p, loss=K.cycle_loss(y, amp, f, p, s))
