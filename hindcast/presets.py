"""Dataset presets: the two panel configurations a user of the reference
runs today, as PanelSpecs. Reading their raw files goes through
``sources.readers.read_panel`` (CSV with an explicit schema or Parquet)."""

from __future__ import annotations

from hindcast.spec import FourierTerm, PanelSpec

# Column roles and feature recipes of the two reference
# dataset configurations (weekly avocado prices; daily M5 store-item sales).
PRESETS: dict[str, PanelSpec] = {
    "avocado": PanelSpec(
        name="avocado",
        date_col="Date",
        target_col="AveragePrice",
        series_id_cols=("region", "type"),
        exogenous_cols=("Total Volume",),
        horizon=12,
        freq="W",
        holiday_country="US",
        default_series={"region": "TotalUS", "type": "conventional"},
        lags=(1, 2, 3, 4, 8, 12, 52),
        rolling_windows=(4, 8, 12, 52),
        fourier=(FourierTerm(52.143, 4),),
        exogenous_lag=1,
        use_exogenous=True,
    ),
    "m5": PanelSpec(
        name="m5",
        date_col="date",
        target_col="sales",
        series_id_cols=("store_id", "item_id"),
        exogenous_cols=("sell_price", "event_name_1", "snap_flag"),
        horizon=28,
        freq="D",
        holiday_country="US",
        lags=(1, 7, 14, 28),
        rolling_windows=(7, 28),
        fourier=(FourierTerm(7, 3), FourierTerm(365.25, 6)),
        exogenous_lag=1,
        use_exogenous=True,
    ),
}

RAW_FILES = {"avocado": "avocado.csv", "m5": "m5.csv"}


def load_preset(name: str) -> PanelSpec:
    """The preset called ``name``; an unknown name lists the available ones."""
    try:
        return PRESETS[name]
    except KeyError:
        raise FileNotFoundError(f"{name!r} is not a preset; choose one of {sorted(PRESETS)}") from None
