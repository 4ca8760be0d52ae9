"""Settings of analyses, checked when they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from ..operators.optimize import SearchConfig


@dataclass(frozen=True)
class DataConfig:
    column: str = "close"
    source_tz: str | None = None


@dataclass(frozen=True)
class DetrendConfig:
    kind: str = "none"
    hp_lambda: float = 1600.0
    hp_lambda_min: float | None = None
    linear_window: int = 0
    jh_lead: int = 24
    jh_lags: int = 12
    lowess_k: float = 4.0

    def __post_init__(self) -> None:
        if self.kind not in ("none", "hp", "band_pass", "linear", "quadratic", "jh", "lowess"):
            raise ValueError(f"unknown detrending: {self.kind}")
        if self.hp_lambda <= 0 or self.linear_window < 0 or self.jh_lead < 1 or self.jh_lags < 1:
            raise ValueError("detrending parameters must be positive")


@dataclass(frozen=True)
class SpectrumConfig:
    num_samples: int = 256
    min_period: float = 10
    max_period: float = 80
    kaiser_beta: float | None = None
    peak_order: int = 10
    bartels_threshold: float = 0.0
    limit_harmonics: int | None = None

    def __post_init__(self) -> None:
        if self.num_samples < 8:
            raise ValueError("num_samples must be 8 at least")
        if not 0 < self.min_period < self.max_period:
            raise ValueError("0 < min_period < max_period is needed")


@dataclass(frozen=True)
class ProjectionConfig:
    cycles: int = 4
    rank_by: str = "global_score"


@dataclass(frozen=True)
class AnalysisConfig:
    data: DataConfig = field(default_factory=DataConfig)
    detrend: DetrendConfig = field(default_factory=DetrendConfig)
    spectrum: SpectrumConfig = field(default_factory=SpectrumConfig)
    projection: ProjectionConfig = field(default_factory=ProjectionConfig)
    as_of: str | None = None
    allow_lookahead: bool = False

    def flat(self) -> dict:
        """All settings as keyword arguments; names are unique."""
        out: dict = {}
        for value in (self.data, self.detrend, self.spectrum, self.projection):
            out |= asdict(value)
        return out | {"as_of": self.as_of, "allow_lookahead": self.allow_lookahead}


@dataclass(frozen=True)
class Band:
    num_samples: int
    cycles: int
    min_period: float
    max_period: float
    hp_lambda: float
    lambda_min: float | None = None


@dataclass(frozen=True)
class MultiConfig:
    bands: tuple[Band, ...] = ()
    detrend: DetrendConfig = field(default_factory=lambda: DetrendConfig(kind="hp"))
    fit: str = "algebraic"
    search: SearchConfig = field(default_factory=SearchConfig)
    reference: str = "longest"
    smooth_reference: bool = False
    as_of: str | None = None

    def __post_init__(self) -> None:
        if not self.bands:
            raise ValueError("at least one band is needed")
        if self.reference not in ("longest", "less_detrended"):
            raise ValueError(f"unknown reference: {self.reference}")
