"""Panel description: which column plays which role, and the feature recipe.

Every transform in the library takes a :class:`PanelSpec` instead of literal
column names, so one plan serves any panel (weekly prices, daily sales, ...).
All validation happens here, on the driver, before any Spark job is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import NamedTuple

# Fixed values that must agree with the reference for identical features:
# the Fourier epoch and the approximate number of days in one base step.
FOURIER_EPOCH = "2010-01-01"
STEP_DAYS = {"D": 1.0, "W": 7.0, "M": 30.4375, "Q": 91.3125, "Y": 365.25}

# Quantile set scored by default (p10 / p50 / p90).
DEFAULT_QUANTILES = (0.1, 0.5, 0.9)

_FREQ_RE = re.compile(r"^(\d*)([A-Za-z]+)(?:-([A-Za-z]+))?$")
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
_FREQ_ALIASES = {
    "D": "D",
    "B": "D",
    "W": "W",
    "M": "M",
    "MS": "M",
    "ME": "M",
    "Q": "Q",
    "QS": "Q",
    "QE": "Q",
    "Y": "Y",
    "YS": "Y",
    "YE": "Y",
    "A": "Y",
    "AS": "Y",
}


def parse_freq(freq: str) -> tuple[int, str]:
    """Return ``(multiple, unit)`` for a pandas-style offset alias.

    Unlike a first-letter lookup, ``"min"`` is not a month and ``"2W"`` is two
    weeks; anything we cannot place is rejected.
    """
    m = _FREQ_RE.match(freq.strip())
    if not m:
        raise ValueError(f"unsupported frequency {freq!r}")
    mult = int(m.group(1) or 1)
    unit = _FREQ_ALIASES.get(m.group(2).upper())
    if unit is None or mult < 1:
        raise ValueError(f"unsupported frequency {freq!r}; use D, W, M, Q or Y (optionally with a multiple)")
    return mult, unit


def freq_anchor(freq: str) -> str | int | None:
    """Which dates of the period ``freq`` steps through: ``"end"`` or
    ``"start"`` of a month, quarter or year, ``"business"`` days, a weekday
    (Monday = 0), or None where any date may begin (``D`` and a plain ``W``).
    As in pandas, ``M``, ``Q`` and ``Y`` alone mean period ends."""
    _, unit = parse_freq(freq)
    m = _FREQ_RE.match(freq.strip())
    alias, suffix = m.group(2).upper(), (m.group(3) or "").upper()
    if alias == "W" and suffix in _WEEKDAYS:
        return _WEEKDAYS.index(suffix)
    calendar = {"Q": ("", "DEC", "JAN"), "Y": ("", "DEC", "JAN")}.get(unit, ("",))
    if suffix not in calendar:
        raise ValueError(f"unsupported anchor in frequency {freq!r}")
    if alias == "B":
        return "business"
    if unit in ("D", "W"):
        return None
    return "start" if alias.endswith("S") else "end"


def step_days(freq: str) -> float:
    mult, unit = parse_freq(freq)
    return mult * STEP_DAYS[unit]


def sanitize(name: str) -> str:
    """A column name that is safe in model inputs: only letters, digits and ``_``."""
    return re.sub(r"\W", "_", name)


@dataclass(frozen=True)
class FourierTerm:
    period: float
    order: int = 3

    def __post_init__(self) -> None:
        if self.period <= 0 or self.order < 1:
            raise ValueError(f"bad Fourier term {self}")


@dataclass(frozen=True)
class PanelSpec:
    """Column roles and feature recipe of one panel (many series in a long table)."""

    name: str
    date_col: str
    target_col: str
    series_id_cols: tuple[str, ...] = ()
    exogenous_cols: tuple[str, ...] = ()
    horizon: int = 28
    freq: str = "D"
    holiday_country: str | None = None
    default_series: tuple[tuple[str, str], ...] = ()
    lags: tuple[int, ...] = (1, 7, 14, 28)
    rolling_windows: tuple[int, ...] = (7, 28)
    fourier: tuple[FourierTerm, ...] = ()
    exogenous_lag: int = 1
    use_exogenous: bool = True
    # WRMSSE weight source; None keeps the reference rule (first exogenous
    # column if present, else the target).
    weight_col: str | None = None
    # 'known': lagged exogenous values inside the horizon are the observed
    # ones (reference behaviour); 'hold': carry the last training value.
    exogenous_mode: str = "known"
    # Extra ordering columns after the date, for panels that may hold
    # several rows per (series, date); empty = the key must be unique.
    tiebreak_cols: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "series_id_cols", tuple(self.series_id_cols))
        object.__setattr__(self, "exogenous_cols", tuple(self.exogenous_cols))
        object.__setattr__(self, "tiebreak_cols", tuple(self.tiebreak_cols))
        object.__setattr__(self, "lags", tuple(int(x) for x in self.lags))
        object.__setattr__(self, "rolling_windows", tuple(int(x) for x in self.rolling_windows))
        object.__setattr__(
            self,
            "fourier",
            tuple(t if isinstance(t, FourierTerm) else FourierTerm(*t) for t in self.fourier),
        )
        ds = self.default_series
        if isinstance(ds, dict):
            object.__setattr__(self, "default_series", tuple(ds.items()))
        if self.horizon < 1:
            raise ValueError(f"horizon must be >= 1, got {self.horizon}")
        if any(x < 1 for x in self.lags):
            raise ValueError(f"lags must be >= 1, got {self.lags}")
        if any(w < 2 for w in self.rolling_windows):
            # min_periods is max(2, w // 2), which cannot exceed a window of 1
            raise ValueError(f"rolling windows must be >= 2, got {self.rolling_windows}")
        if self.exogenous_lag < 0:
            raise ValueError("exogenous_lag must be >= 0")
        if self.exogenous_mode not in ("known", "hold"):
            raise ValueError("exogenous_mode must be 'known' or 'hold'")
        parse_freq(self.freq)
        exog_names = [f"{sanitize(c)}_lag{self.exogenous_lag}" for c in self.exogenous_cols]
        if len(set(exog_names)) != len(exog_names):
            raise ValueError(f"exogenous columns collide after sanitising: {exog_names}")

    # -- derived ---------------------------------------------------------
    @property
    def step_days(self) -> float:
        return step_days(self.freq)

    @property
    def max_lookback(self) -> int:
        """Rows of history any feature of one row can reach back to."""
        return max([*self.lags, *self.rolling_windows, self.exogenous_lag, 1])

    def with_(self, **kw) -> PanelSpec:
        return replace(self, **kw)


class FeatureSpec(NamedTuple):
    """Names of the model inputs by kind, each in the order of the matrix."""

    numeric: list[str]
    categorical: list[str]

    @property
    def n_inputs(self) -> int:
        return sum(map(len, self))


def metric_name(q: float) -> str:
    """``pinball_p10`` for q=0.1 (round half to even, two digits)."""
    if not 0.0 < q < 1.0:
        raise ValueError(f"quantile must be in (0, 1), got {q}")
    return f"pinball_p{int(round(q * 100)):02d}"
